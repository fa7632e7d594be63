"""Queries of the inventories, routes and import graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import relations as rel
from bindings.q_files import _repo_files
from bindings.templates import SYMLINK_PATHS
from factloom.functions import paths
from factloom.functions.checkpoints import cut, stored
from factloom.operators import files, graph, infra, inventory, manifests, patterns, pii, routes, slices, symbols


def _files_table(spark, sf):
    """The derived files as a stored table, for queries that scan them several times."""
    return stored(_repo_files(spark, sf), "files")


def _found(spark, sf, f=None):
    """Parsed manifests, written once: narrow facts that the inventories read several times."""
    return cut(manifests.manifests(f if f is not None else _repo_files(spark, sf)))


def _deps(spark, sf, f=None):
    return manifests.dependencies(_found(spark, sf, f))


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text, for comparison."""
    return df.select(*[F.array_join(c, ",").alias(c) if c in columns else F.col(c) for c in df.columns])


def dep_frameworks(spark, sf) -> DataFrame:
    return inventory.dep_frameworks(_deps(spark, sf))


def framework_inventory(spark, sf) -> DataFrame:
    found = _found(spark, sf)
    out = inventory.framework_inventory(_repo_files(spark, sf), manifests.dependencies(found), found)
    return _listed(out, "frameworks", "secondary_frameworks")


def dep_db_engines(spark, sf) -> DataFrame:
    return inventory.dep_db_engines(_deps(spark, sf), _repo_files(spark, sf))


def dep_orm(spark, sf) -> DataFrame:
    return inventory.dep_orm(_deps(spark, sf), _repo_files(spark, sf))


def dep_migration_tool(spark, sf) -> DataFrame:
    return inventory.dep_migration_tool(_deps(spark, sf), _repo_files(spark, sf))


def migration_count(spark, sf) -> DataFrame:
    return inventory.migration_count(_repo_files(spark, sf))


def connection_env_vars(spark, sf) -> DataFrame:
    return inventory.connection_env_vars(_repo_files(spark, sf))


def database_inventory(spark, sf) -> DataFrame:
    f = _files_table(spark, sf)
    out = inventory.database_inventory(f, _deps(spark, sf, f))
    return _listed(out, "engines", "connection_env_vars")


def phi_tables(spark, sf) -> DataFrame:
    f = _files_table(spark, sf)
    return inventory.phi_tables(f, pii.pii_candidates(f))


def dep_auth_type(spark, sf) -> DataFrame:
    return inventory.dep_auth_type(_deps(spark, sf))


def auth_files(spark, sf) -> DataFrame:
    return inventory.auth_files(_repo_files(spark, sf))


def auth_inventory(spark, sf) -> DataFrame:
    f = _files_table(spark, sf)
    deps = _deps(spark, sf, f)
    return inventory.auth_inventory(f, deps, _routes_of(f, deps))


def dep_test_frameworks(spark, sf) -> DataFrame:
    return inventory.dep_test_frameworks(_deps(spark, sf))


def coverage_tooling(spark, sf) -> DataFrame:
    found = _found(spark, sf)
    return inventory.coverage_tooling(manifests.dependencies(found), found)


def test_inventory(spark, sf) -> DataFrame:
    found = _found(spark, sf)
    out = inventory.test_inventory(_repo_files(spark, sf), manifests.dependencies(found), found)
    return _listed(out, "test_frameworks")


def dependency_listing(spark, sf) -> DataFrame:
    return inventory.dependency_listing(_deps(spark, sf))


def infra_flags(spark, sf) -> DataFrame:
    return infra.infra_flags(_repo_files(spark, sf))


def deployment_targets(spark, sf) -> DataFrame:
    f = _repo_files(spark, sf)
    return infra.deployment_targets(f, infra.ci_workflows(f))


def cicd_inventory(spark, sf) -> DataFrame:
    f = _repo_files(spark, sf)
    return _listed(infra.cicd_inventory(f, infra.ci_workflows(f)), "targets")


def ci_tools(spark, sf) -> DataFrame:
    f = _repo_files(spark, sf)
    return _listed(infra.ci_tools(infra.infra_flags(f), infra.ci_workflows(f)), "tools")


# ---------------------------------------------------------------- routes


def _routes_of(f, deps):
    return cut(routes.union_routes(f, deps, inventory.dep_frameworks(deps)))


def _routes(spark, sf):
    return _routes_of(_repo_files(spark, sf), _deps(spark, sf))


def _extractor(name: str):
    def query(spark, sf) -> DataFrame:
        return routes.extract_routes(_repo_files(spark, sf), (name,))

    query.__name__ = f"routes_{name}"
    return query


def union_routes(spark, sf) -> DataFrame:
    return _routes(spark, sf)


def route_auth_split(spark, sf) -> DataFrame:
    return routes.auth_coverage(_routes(spark, sf))


def health_check_present(spark, sf) -> DataFrame:
    return routes.health_check_present(_routes(spark, sf))


def phi_adjacent_routes(spark, sf) -> DataFrame:
    f = _files_table(spark, sf)
    return routes.phi_adjacent_routes(_routes_of(f, _deps(spark, sf, f)), pii.pii_candidates(f))


# ---------------------------------------------------------------- graph


def _graph(spark, sf, *lists):
    """Catalog, symbols and edges; of the symbols what the edges and the query (``lists``) use."""
    f = _files_table(spark, sf)
    cat = files.catalog(f.withColumn("is_symlink", F.col("path").isin(*SYMLINK_PATHS)))
    # columnar: the imports are read several times, the other lists by some queries only; unread ones are not scanned for
    syms = stored(symbols.source_symbols(cat).select("repo_id", "path", "imports", *lists), "symbols")
    edges = graph.resolve_imports(symbols.raw_imports(syms), f.select("repo_id", "path"), files.workspace_packages(f))
    return cat, syms, edges


def resolve_relative_path(spark, sf) -> DataFrame:
    """Paths of derived modules joined with relative references built from the same row."""
    li = rel.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    o, n, p = (F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    here = F.concat(F.lit("src/o"), o, F.lit("/l"), n, F.lit(".ts"))
    ref = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("../../x/./p"), p)).when(
        F.col("l_linenumber") % 3 == 1, F.concat(F.lit("../../../../p"), p)
    ).otherwise(F.concat(F.lit("./a//b/../p"), p))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", paths.resolve_relative(here, ref).alias("resolved"))


def import_edges(spark, sf) -> DataFrame:
    return _graph(spark, sf)[2].drop("import_no")


def cross_package_imports(spark, sf) -> DataFrame:
    return _graph(spark, sf)[2].filter("is_cross_package").select("repo_id", "src", "raw_import", "dst")


def degree_counts(spark, sf) -> DataFrame:
    return graph.degree_counts(_graph(spark, sf)[2])


def hub_files(spark, sf) -> DataFrame:
    return graph.hub_files(_graph(spark, sf)[2])


def entry_points(spark, sf) -> DataFrame:
    _, syms, edges = _graph(spark, sf, "exports", "has_default_export")
    return graph.entry_points(syms, edges)


def top_entry_points(spark, sf) -> DataFrame:
    _, syms, edges = _graph(spark, sf, "exports", "has_default_export")
    return graph.top_entry_points(graph.entry_points(syms, edges), 10)


def leaf_files(spark, sf) -> DataFrame:
    _, syms, edges = _graph(spark, sf)
    return graph.leaf_files(syms, edges)


def key_modules(spark, sf) -> DataFrame:
    cat, syms, edges = _graph(spark, sf, "exports")
    return graph.key_modules(graph.hub_files(edges), cat.select("repo_id", "path", "extraction_type"), syms)


def rank_sources_capped(spark, sf) -> DataFrame:
    """With a detail budget of 20 files, which the derived repositories exceed."""
    _, syms, edges = _graph(spark, sf, "exports", "has_default_export")
    return graph.rank_sources(syms, edges, cap=20)


def _order_graph(spark, sf) -> DataFrame:
    """Orders as repositories of parts: an edge from each line's part to the next line's supplier-chosen part."""
    li = rel.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo_id"),
        (F.col("l_partkey") % 97).cast("string").alias("src"), (F.col("l_orderkey") % 89).cast("string").alias("dst"),
        F.lit(False).alias("is_external"),
    )


def import_cycles(spark, sf) -> DataFrame:
    return graph.import_cycles(_graph(spark, sf)[2])


def part_graph_cycles(spark, sf) -> DataFrame:
    return graph.import_cycles(_order_graph(spark, sf))


def cycle_paths(spark, sf) -> DataFrame:
    """One shortest cycle through the smallest part of each component."""
    return graph.cycle_paths(_order_graph(spark, sf))


PREFIXES = ("src/", "packages/core", "app/")


def slice_by_prefix(spark, sf) -> DataFrame:
    return slices.slice_rows(_repo_files(spark, sf).select("repo_id", "path"), PREFIXES)


def slice_edges(spark, sf) -> DataFrame:
    return slices.slice_edges(_graph(spark, sf)[2].drop("import_no"), ("packages/",))


def slice_by_prefix_table(spark, sf) -> DataFrame:
    """Slices named by rows: two per repository, from the customer table."""
    c = rel.table(spark, sf, "customer").select(F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("repo_id"))
    rows = F.array(
        F.struct(F.lit("sources").alias("slice"), F.lit("src/").alias("prefix")),
        F.struct(F.lit("sources").alias("slice"), F.lit("src/a").alias("prefix")),
        F.struct(F.lit("data").alias("slice"), F.lit("data/").alias("prefix")),
    )
    table = c.select("repo_id", F.explode(rows).alias("r")).select("repo_id", "r.*")
    return slices.slice_by_prefix_table(_repo_files(spark, sf).select("repo_id", "path"), table)


def slice_cycles(spark, sf) -> DataFrame:
    return slices.slice_cycles(graph.import_cycles(_order_graph(spark, sf)), ("1", "2"))


# ---------------------------------------------------------------- fingerprints of the derived repositories


def _stack(spark, sf):
    f = _files_table(spark, sf)
    found = _found(spark, sf, f)
    deps = manifests.dependencies(found)
    lang = files.primary_language(files.catalog(f, read=False))
    fw = inventory.framework_inventory(f, deps, found).select("repo_id", "primary_framework")
    auth = inventory.first_auth_type(inventory.auth_inventory(f, deps, _routes_of(f, deps)))
    cicd = infra.cicd_inventory(f, infra.ci_workflows(f))
    return (
        lang.join(fw, "repo_id", "left").join(inventory.dep_orm(deps, f), "repo_id", "left")
        .join(auth, "repo_id", "left").join(cicd, "repo_id", "left")
    )


def repo_fingerprints(spark, sf) -> DataFrame:
    s = _stack(spark, sf)
    deploy = patterns.deployment_segment(
        F.coalesce("kubernetes", F.lit(False)), F.coalesce("has_dockerfile", F.lit(False)),
        F.coalesce("targets", F.expr("cast(array() as array<string>)")),
    )
    fp = patterns.fingerprint(F.col("primary_language"), F.col("primary_framework"), F.col("orm"), F.col("auth_type"), deploy)
    return s.select("repo_id", fp.alias("fingerprint"), inventory.runtime_of(F.col("primary_language")).alias("runtime"))


QUERIES = {
    f.__name__: f
    for f in (
        dep_frameworks, framework_inventory, dep_db_engines, dep_orm, dep_migration_tool, migration_count, connection_env_vars,
        database_inventory, phi_tables, dep_auth_type, auth_files, auth_inventory, dep_test_frameworks, coverage_tooling,
        test_inventory, dependency_listing, infra_flags, deployment_targets, cicd_inventory, ci_tools,
        *[_extractor(n) for n in routes.EXTRACTORS], union_routes, route_auth_split, health_check_present, phi_adjacent_routes,
        resolve_relative_path, import_edges, cross_package_imports, degree_counts, hub_files, entry_points, top_entry_points,
        leaf_files, key_modules, rank_sources_capped, import_cycles, part_graph_cycles, cycle_paths, slice_by_prefix, slice_edges,
        slice_by_prefix_table, slice_cycles, repo_fingerprints,
    )
}
