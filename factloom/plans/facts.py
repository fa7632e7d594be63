"""All facts of a set of repositories, and the scrub-and-attest step, as named lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from factloom.functions.checkpoints import cut
from factloom.operators import attest, env, files, graph, infra, inventory, manifests, pii, routes, symbols


def repository_facts(source: DataFrame, materialize: bool = True) -> dict[str, DataFrame]:
    """Fact tables of a files table (repo_id, path, content).

    Contents are scanned by lazy branches; with ``materialize`` the narrow facts that several branches read (symbols and
    manifests) are written once below the checkpoint folder instead of being recomputed from contents.
    """
    keep = cut if materialize else (lambda df: df)
    kept = files.drop_excluded_paths(source)
    cat = files.catalog(source)
    syms = keep(symbols.source_symbols(cat))
    found = keep(manifests.manifests(kept))
    deps = manifests.dependencies(found)
    frameworks = inventory.dep_frameworks(deps)
    found_routes = routes.union_routes(kept, deps, frameworks)
    workflows = infra.ci_workflows(kept)
    candidates = pii.pii_candidates(kept)
    edges = graph.resolve_imports(symbols.raw_imports(syms), kept.select("repo_id", "path"), files.workspace_packages(kept))
    return {
        "catalog": cat, "symbols": syms, "manifests": found, "dependencies": deps,
        "languages": files.language_inventory(files.catalog(source, read=False)),
        "frameworks": inventory.framework_inventory(kept, deps, found), "routes": found_routes,
        "databases": inventory.database_inventory(kept, deps), "env_vars": env.env_inventory(kept),
        "auth": inventory.auth_inventory(kept, deps, found_routes), "workflows": workflows,
        "cicd": infra.cicd_inventory(kept, workflows), "tests": inventory.test_inventory(kept, deps, found),
        "pii_candidates": candidates, "phi_zones": pii.phi_zones(candidates),
        "import_edges": edges, "hub_files": graph.hub_files(edges), "entry_points": graph.entry_points(syms, edges),
        "leaf_files": graph.leaf_files(syms, edges),
    }


@dataclass(frozen=True)
class Scrubbed:
    payloads: DataFrame
    entries: DataFrame
    uncertain: DataFrame
    counts: DataFrame


def scrub_and_attest(
    texts: DataFrame, key: str, text: str, analyst_id: str, repo: Column, commit: Column, detected_at: Column, patterns=None
) -> Scrubbed:
    """Scrub every payload, fail the job when one is still impure, and link its replacements in an audit chain."""
    args = {} if patterns is None else {"patterns": patterns}
    scrubbed = pii.scrub(texts, [key], text, **args)
    return Scrubbed(
        payloads=pii.assert_pure(scrubbed, [key], "scrubbed", **args),
        entries=attest.attestation_chain(scrubbed, key, analyst_id, repo, commit, detected_at),
        uncertain=pii.uncertain_detections(scrubbed, [key]),
        counts=pii.detection_counts(scrubbed, [key]),
    )
