"""Steps of the import graph that must not cost a sort, a shuffle or a Python frame for each repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import signals
from factloom.functions import joins
from factloom.operators import graph


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycles_of_many_repositories_in_one_task(spark):
    """Repositories follow one another in a task, and one of them is longer than an Arrow batch."""
    small = spark.range(300).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo_id"), F.explode(F.array(
        F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst")), F.struct(F.lit("b").alias("src"), F.lit("a").alias("dst")),
        F.struct(F.lit("b").alias("src"), F.lit("c").alias("dst")), F.struct(F.lit("d").alias("src"), F.lit("d").alias("dst")))).alias("e")).select("repo_id", "e.*")
    ring = spark.range(25_000).select(F.lit("ring").alias("repo_id"), F.col("id").cast("string").alias("src"), ((F.col("id") + 1) % 25_000).cast("string").alias("dst"))
    edges = small.unionByName(ring).coalesce(1).withColumn("is_external", F.lit(False))
    found = graph.cycles(edges)
    assert "FlatMapGroupsInPandas" not in _plan(found)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.repo_id, []).append((r.path, r.component, r.step))
    assert len(rows) == 301 and all(sorted(v) == [("a", "a", 0), ("b", "a", 1), ("d", "d", 0)] for k, v in rows.items() if k != "ring")
    assert sorted(rows["ring"]) == sorted((str(i), "0", i) for i in range(25_000))
    assert graph.cycles(edges.limit(0)).count() == 0


def test_stems_are_a_minimum_of_numbers(spark):
    paths = ["", ".ts", "a.ts", "a.js", "a", "a.TS", "a.b/c", "a.d.ts", "x/.py", "index.ts", "/index.ts", "x/index.ts", "x/index.js", "x.ts", "x/mod.ts", "x/__init__.py", "é.rb", "y/index.rb"]
    known, indexes = list(signals.RESOLVE_EXTENSIONS), list(signals.RESOLVE_INDEXES)
    best: dict[str, tuple[int, str]] = {}
    for path in paths:
        dotted = "." in path[1:]
        ext = "." + path.rsplit(".", 1)[-1] if dotted else ""
        named = [(0, path)] + ([(1 + known.index(ext), path[: -len(ext)])] if ext in known else [])
        named += [(1 + len(known) + i, path[: -len(x)]) for i, x in enumerate(indexes) if path.endswith(x)]
        for rank, stem in named:
            best[stem] = min(best.get(stem, (99, "")), (rank, path))
    files = spark.createDataFrame([("r", p) for p in [*paths, *paths, None]], "repo_id string, path string")
    stems = graph.resolution_stems(files)
    assert "SortAggregate" not in _plan(stems)
    assert {r.stem: r.target for r in stems.where("stem is not null").collect()} == {k: v[1] for k, v in best.items()}


def test_hot_keys_are_found_in_full_bins(spark):
    stream = spark.range(4000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 1000, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"))
    counts = joins._counts(stream, [F.col("k")], 500)
    assert [tuple(r) for r in counts.where("count > 500").collect()] == [("hot", 900)] and counts.count() < 100
    assert joins._counts(stream, [F.col("k")], 5000).count() == 0
