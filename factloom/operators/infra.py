"""Continuous integration, containers and deployment targets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.paths import basename
from factloom.functions.ranking import first_per_key
from factloom.functions.regex import extract_groups, to_java

try:
    import yaml
except ImportError:  # the indentation reader below covers the common layout
    yaml = None


def _read_workflow(content: str):
    """(name, triggers, jobs) of one workflow file; None when it is not a mapping."""
    if yaml is not None:
        try:
            doc = yaml.safe_load(content)
        except yaml.YAMLError:
            return None
        if not isinstance(doc, dict):
            return None
        name = doc.get("name")
        on = doc.get("on", doc.get(True))
        if isinstance(on, str):
            triggers = [on]
        elif isinstance(on, list):
            triggers = [t for t in on if isinstance(t, str)]
        else:
            triggers = [str(t) for t in on] if isinstance(on, dict) else []
        jobs = doc.get("jobs")
        return name if isinstance(name, str) else None, triggers, [str(j) for j in jobs] if isinstance(jobs, dict) else []
    name = re.search(r"(?m)^name:[ \t]*(\S.*?)[ \t]*$", content)
    inline = re.search(r"(?m)^on:[ \t]*(\S.*?)[ \t]*$", content)
    sections = {k: re.findall(r"(?m)^  (\S+):", body) for k, body in re.findall(r"(?ms)^(\w+):\s*\n(.*?)(?=^\S|\Z)", content)}
    triggers = re.findall(r"[\w-]+", inline[1]) if inline else sections.get("on", [])
    return name[1] if name else None, triggers, sections.get("jobs", [])


def ci_workflows(files: DataFrame) -> DataFrame:
    """(repo_id, path, workflow, triggers, jobs) of workflow files; only the YAML reader is Python."""
    path = F.col("path")
    wanted = files.filter(
        path.contains(".github/workflows/") & (path.endswith(".yml") | path.endswith(".yaml")) & (F.col("content") != "")
    ).select("repo_id", "path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, where, content in pdf.itertuples(index=False):
                found = _read_workflow(content)
                if found:
                    fallback = re.sub(r"\.ya?ml$", "", where.rsplit("/", 1)[-1])
                    rows.append((repo, where, found[0] or fallback, found[1], found[2]))
            yield pd.DataFrame(rows, columns=["repo_id", "path", "workflow", "triggers", "jobs"])

    schema = "repo_id string, path string, workflow string, triggers array<string>, jobs array<string>"
    return wanted.mapInPandas(read, schema)


def exposed_ports(files: DataFrame) -> DataFrame:
    """Distinct (repo_id, port) from EXPOSE lines and compose port pairs."""
    path, name = F.col("path"), basename(F.col("path"))
    docker = files.filter((name == "Dockerfile") | name.startswith("Dockerfile."))
    compose = files.filter(name.startswith("docker-compose") | path.contains("/compose/"))
    from_docker = extract_groups(F.col("content"), to_java(r"^EXPOSE\s+(\d+)", "m"))
    from_compose = extract_groups(F.col("content"), to_java(r"""["']?(\d+):(\d+)["']?"""))
    ports = docker.select("repo_id", F.explode(from_docker).alias("port")).unionByName(
        compose.select("repo_id", F.explode(from_compose).alias("port"))
    )
    return ports.select("repo_id", F.col("port").try_cast("int").alias("port")).filter("port > 0").distinct()


def make_targets(files: DataFrame) -> DataFrame:
    """Distinct targets of the first Makefile of a repository, in order."""
    makefiles = files.filter(basename(F.col("path")) == "Makefile").select("repo_id", "path", "content")
    first = first_per_key(makefiles, ["repo_id"], [F.col("path")])
    targets = F.array_distinct(extract_groups(F.col("content"), to_java(r"^([a-zA-Z0-9_-]+)\s*:", "m")))
    return first.select("repo_id", "path", F.posexplode(targets).alias("i", "target")).select(
        "repo_id", "path", (F.col("i") + 1).alias("target_no"), "target"
    )


def infra_flags(files: DataFrame) -> DataFrame:
    """Docker / compose / Kubernetes / Helm / Make flags per repository, one combinable aggregate over paths."""
    path, name = F.col("path"), basename(F.col("path"))
    k8s = path.contains("k8s/") | path.contains("kubernetes/") | path.contains("manifests/") | (
        name.endswith(".yaml") & (name.contains("deployment") | name.contains("service") | name.contains("ingress"))
    )
    return files.groupBy("repo_id").agg(
        F.bool_or((name == "Dockerfile") | name.startswith("Dockerfile.")).alias("has_dockerfile"),
        F.bool_or(name.startswith("docker-compose.")).alias("has_compose"),
        F.bool_or(k8s).alias("kubernetes"),
        F.bool_or(path.contains("helm/") | name.isin("Chart.yaml", "values.yaml")).alias("helm"),
        F.bool_or(name == "Makefile").alias("makefile"),
    )


def deployment_targets(files: DataFrame, workflows: DataFrame) -> DataFrame:
    """Distinct (repo_id, target, ord) where ``ord`` is the reporting order."""
    flags = infra_flags(files)
    from_flags = flags.select(
        "repo_id",
        F.explode(F.array_compact(F.array(*[
            F.when(F.col(c), F.struct(F.lit(i).alias("ord"), F.lit(t).alias("target")))
            for i, (c, t) in enumerate((("kubernetes", "Kubernetes"), ("helm", "Helm"), ("has_dockerfile", "Docker")))
        ]))).alias("t"),
    ).select("repo_id", "t.*")
    lower = F.lower("workflow")
    deploys = lower.contains("deploy") | lower.contains("release") | lower.contains("publish")
    words = []
    for i, (target, word, more) in enumerate(signals.WORKFLOW_TARGETS, 10):
        hit = lower.contains(word) | F.exists("jobs", _contains(word))
        for extra in more:
            hit = hit | lower.contains(extra)
        words.append(F.when(deploys & hit, F.struct(F.lit(i).alias("ord"), F.lit(target).alias("target"))))
    from_flows = workflows.select("repo_id", F.explode(F.array_compact(F.array(*words))).alias("t")).select("repo_id", "t.*")
    name, path = basename(F.col("path")), F.col("path")
    rules = [F.when(name == n, F.struct(F.lit(i).alias("ord"), F.lit(t).alias("target"))) for i, (n, t) in enumerate(signals.TARGET_FILES, 30)]
    rules.append(F.when((name == "app.yaml") & path.contains("appengine"), F.struct(F.lit(29).alias("ord"), F.lit("GCP App Engine").alias("target"))))
    from_files = files.select("repo_id", F.explode(F.array_compact(F.array(*rules))).alias("t")).select("repo_id", "t.*")
    both = from_flags.unionByName(from_flows).unionByName(from_files)
    return both.groupBy("repo_id", "target").agg(F.min("ord").alias("ord"))


def _contains(word: str):
    return lambda j: j.contains(word)


def ci_tools(flags: DataFrame, workflows: DataFrame) -> DataFrame:
    """Tools present, in reporting order."""
    with_ci = workflows.select("repo_id").distinct().withColumn("_ci", F.lit(True))
    joined = flags.join(with_ci, "repo_id", "left")
    rules = ((F.col("_ci").isNotNull(), "GitHub Actions"), (F.col("has_dockerfile"), "Docker"), (F.col("kubernetes"), "Kubernetes"), (F.col("helm"), "Helm"), (F.col("makefile"), "Make"))
    tools = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return joined.select("repo_id", tools.alias("tools"))


def cicd_inventory(files: DataFrame, workflows: DataFrame) -> DataFrame:
    """One row per repository: flags, number of workflows and deployment targets (at most one per known target)."""
    flows = workflows.groupBy("repo_id").agg(F.count("*").alias("workflows"))
    targets = deployment_targets(files, workflows).groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "target"))), lambda t: t["target"]).alias("targets")
    )
    return (
        infra_flags(files).join(flows, "repo_id", "left").join(targets, "repo_id", "left")
        .withColumn("workflows", F.coalesce("workflows", F.lit(0).cast("long")))
        .withColumn("targets", F.coalesce("targets", F.expr("cast(array() as array<string>)")))
    )
