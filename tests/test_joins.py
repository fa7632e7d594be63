from statistics import median

import pytest
from pyspark.sql import functions as F

from factloom.functions.joins import lookup_join
from factloom.operators import graph


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    """90 % of the imports point at one hub."""
    stream = spark.range(40_000).select(
        F.lit("r").alias("repo_id"), F.when(F.col("id") % 10 != 0, "hub").otherwise(F.concat(F.lit("f"), (F.col("id") / 40).cast("int").cast("string"))).alias("stem"),
        F.concat(F.lit("src/"), F.col("id").cast("string")).alias("src"), F.lit(1).alias("clash"))
    odd = spark.createDataFrame([("r", None, "n", 1), (None, "hub", "n", 1), ("r", "missing", "n", 1)], "repo_id string, stem string, src string, clash int")
    table = stream.select("repo_id", "stem").distinct().withColumn("target", F.concat("stem", F.lit(".ts")))
    return stream.union(odd).union(odd), table.union(spark.createDataFrame([("r", "never", "x")], "repo_id string, stem string, target string"))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("most_hot", [0, 100])
def test_same_rows_as_a_plain_join(tables, how, most_hot):
    stream, table = tables
    want = rows(stream.join(table, ["repo_id", "stem"], how))
    assert rows(lookup_join(stream, table, ["repo_id", "stem"], how, 500, most_hot).select("repo_id", "stem", "src", "clash", "target")) == want
    assert rows(lookup_join(stream, table, ["repo_id", "stem"], how)) == want
    assert lookup_join(stream.limit(0), table, ["repo_id", "stem"], how, 500).count() == 0
    assert lookup_join(stream, table.limit(0), ["repo_id", "stem"], how, 500).count() == (stream.count() if how == "left" else 0)


def test_no_task_gets_the_hub(spark, tables):
    stream, table = tables
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "-1", "8")):
            spark.conf.set(n, v)

        def loads(df):
            return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]

        plain = loads(stream.join(table, ["repo_id", "stem"], "left"))
        salted = loads(lookup_join(stream, table, ["repo_id", "stem"], "left", 200))
        assert max(plain) > 3 * median(plain)
        assert len(salted) == 8 and sum(salted) == sum(plain) and max(salted) < 3 * median(salted)
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_imports_of_a_hub_are_the_same_edges(spark):
    imports = spark.range(3000).select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit(1).alias("import_no"),
        F.when(F.col("id") % 10 < 6, "./hub").when(F.col("id") % 10 < 9, "@a/core/x").otherwise(F.concat(F.lit("./f"), F.col("id").cast("string"))).alias("raw_import"))
    paths = imports.select("repo_id", "path").union(spark.createDataFrame([("r", "src/hub/index.ts"), ("r", "packages/core/x.ts")], "repo_id string, path string"))
    packages = spark.createDataFrame([("r", "packages/core", "packages/core/package.json", "@a/core")], "repo_id string, package_path string, manifest_path string, package_name string")
    plain, salted = (graph.resolve_imports(imports, paths, packages, n) for n in (10**6, 50))
    assert rows(plain) == rows(salted.select(*plain.columns))
    assert plain.where("dst = 'src/hub/index.ts'").count() == 1800 and plain.where("dst = 'packages/core/x.ts'").count() == 900
