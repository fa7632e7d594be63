"""Relations that Spark derives from the shared tables for the operators to run on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import templates as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of only a few splits (test data in one small file).  A large input has more splits
    than the cluster has cores and passes as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def _fill(template: Column, values: dict[str, Column]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit("{%s}" % kv[0]), kv[1].cast("string")), values.items(), template)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, configuration, routes and so on: templates x customers, by an equi-join on the kit."""
    rows = spark.createDataFrame(t.project_rows(), "combo int, tpl_path string, tpl string")  # < 1000 fixed rows
    repos = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).select(
        "c_custkey", "c_nationkey", (F.col("c_custkey") % (t.KITS * t.VARIANTS)).cast("int").alias("combo")
    )
    values = {"id": F.col("c_custkey"), "nat": F.col("c_nationkey")}
    return repos.join(F.broadcast(rows), "combo").select(
        F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("repo_id"),
        F.col("tpl_path").alias("path"),
        _fill(F.col("tpl"), values).alias("content"),
    )


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source modules: one per (order, line number), in the repository of the order's customer."""
    rows = spark.createDataFrame(t.module_rows(), "combo int, tpl_path string, tpl string")  # 20 fixed rows
    # one exchange serves the aggregate and the join; given a number, it is not coalesced by its (small) narrow rows
    # before the (large) contents are built
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .repartition(partitions, "l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    combo = (
        (F.col("o_custkey") % t.KITS) * 4
        + F.when(F.col("part") % 3 == 0, 2).otherwise(0)
        + F.when(F.col("part") % 4 == 0, 1).otherwise(0)
    )
    n = F.col("l_linenumber")
    values = {
        "o": F.col("l_orderkey"), "n": n, "prev": F.when(n == 1, 2).otherwise(n - 1), "nxt": n + 1,
        "part": F.col("part"), "supp": F.col("supp"),
    }
    return joined.withColumn("combo", combo.cast("int")).join(F.broadcast(rows), "combo").select(
        F.concat(F.lit("repo-"), F.col("o_custkey").cast("string")).alias("repo_id"),
        _fill(F.col("tpl_path"), values).alias("path"),
        _fill(F.col("tpl"), values).alias("content"),
    )


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_files(spark, sf_dir).unionByName(module_files(spark, sf_dir))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and web pages by host, as files."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("docs-"), "source").alias("repo_id"),
        F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    url = F.col("url")
    pages = spread(table(spark, sf_dir, "pages")).select(
        F.concat(F.lit("site-"), F.regexp_extract(url, r"^https?://([^/?#]*)", 1)).alias("repo_id"),
        F.concat(
            F.lit("www/"), F.col("page_id").cast("string"), F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
        ).alias("path"),
        F.col("html").alias("content"),
    )
    return docs.unionByName(pages)


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).unionByName(text_files(spark, sf_dir))


def pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and one note per customer that carries one of the detectable forms."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    forms = spark.createDataFrame(list(enumerate(t.NOTES)), "form int, tpl string")  # 25 fixed rows
    key = F.col("c_custkey")
    values = {
        "k": F.lpad((key % 100000).cast("string"), 5, "0"), "k3": F.lpad((key % 1000).cast("string"), 3, "0"),
    }
    notes = (
        spread(table(spark, sf_dir, "customer").select("c_custkey"))
        .select("c_custkey", (key % len(t.NOTES)).cast("int").alias("form"))
        .join(F.broadcast(forms), "form")
        .select((key + t.NOTE_ID_BASE).alias("doc_id"), _fill(F.col("tpl"), values).alias("text"))
    )
    return docs.unionByName(notes)
