"""Queries of sources, sinks, streams and user-supplied signal tables.  Files go to a fresh folder below the checkpoint root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import relations as rel
from bindings.q_files import _catalog
from bindings.q_patterns import _fingerprint, _patterns, _uses
from bindings.q_pii import DETECTED_AT, _chain
from factloom import signals
from factloom.functions.checkpoints import scratch
from factloom.operators import attest, files, patterns, pii
from factloom.sources import files as file_source
from factloom.sources import stores
from factloom.streaming import jobs


def scan_and_read_files(spark, sf) -> DataFrame:
    """Documents written as text files per source, then scanned as repositories."""
    root = scratch(spark, "tree")
    docs = rel.table(spark, sf, "documents").select(F.concat(F.lit("docs-"), "source").alias("source"), "text")
    docs.write.partitionBy("source").text(root)
    read = file_source.read_text(file_source.scan_files(spark, root))
    visible = read.filter(F.col("path").endswith(".txt"))
    return visible.groupBy("repo_id").agg(
        F.sum("size_bytes").alias("bytes"), F.sum(F.length("content")).alias("chars"), F.count_if("is_binary").alias("binary_files")
    )


def scan_paths(spark, sf) -> DataFrame:
    """The scan without contents: sizes by repository."""
    root = scratch(spark, "pages")
    pages = rel.table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("host"), "html")
    pages.write.partitionBy("host").text(root)
    scanned = file_source.scan_files(spark, root).filter(F.col("path").endswith(".txt"))
    return scanned.groupBy("repo_id").agg(F.sum("size_bytes").alias("bytes"))


def _documents(spark, sf) -> DataFrame:
    """Pattern documents from the flat patterns."""
    p = _patterns(spark, sf)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    text = lambda: F.lit(None).cast("string")
    return p.select(
        F.lit("1").alias("schema_version"), "pattern_id", "fingerprint", "status", at.alias("created_at"),
        F.timestamp_add("HOUR", (F.col("store_ord") % 7).cast("int"), at).alias("updated_at"), F.col("last_used_at").cast("timestamp").alias("last_used_at"),
        F.struct(
            "use_count", "probation_uses", "success_count", "avg_savings", "fitness_score",
            F.array(F.struct(F.lit("2024-01-01").alias("date"), F.col("fitness_score").alias("score"), F.col("use_count"))).alias("fitness_history"),
        ).alias("fitness"),
        F.struct(
            F.array(F.lit("server")).alias("entry_points"), F.lit("api").alias("layers"), text().alias("auth_pattern"), text().alias("db_pattern"),
            text().alias("test_pattern"), text().alias("infra_pattern"),
        ).alias("stack_patterns"),
        F.array(F.lit("step")).alias("analysis_sequence"),
        F.array(F.struct(F.lit("Security").alias("dimension"), F.lit("gap").alias("gap"), F.lit("P1").alias("severity"), F.lit(0.5).alias("frequency"))).alias("common_gaps"),
    )


def _store(spark, sf) -> str:
    """A store with a first version of every document and a later one (one more use) of those of even parts, plus garbage."""
    path = scratch(spark, "patterns")
    docs = _documents(spark, sf)
    stores.upsert_patterns(docs, path)
    later = docs.filter(F.substring("pattern_id", 2, 20).cast("long") % 2 == 0)
    newer = later.withColumn("updated_at", F.timestamp_add("DAY", F.lit(1), "updated_at")).withColumn(
        "fitness", F.col("fitness").withField("use_count", F.col("fitness.use_count") + 1)
    )
    stores.upsert_patterns(newer, path)
    rel.table(spark, sf, "part").select(F.concat(F.lit("{broken "), F.col("p_partkey").cast("string")).alias("value")).write.mode("append").text(stores.store_folders(spark, path)[0])
    return path


def read_pattern_store(spark, sf) -> DataFrame:
    flat = stores.flatten_patterns(stores.read_pattern_store(spark, _store(spark, sf)))
    return flat.select("pattern_id", "fingerprint", "status", "use_count", "fitness_score")


def upsert_pattern(spark, sf) -> DataFrame:
    """Write, replace, compact to a new folder, read."""
    path, target = _store(spark, sf), scratch(spark, "compact")
    stores.compact_pattern_store(spark, path, target)
    flat = stores.flatten_patterns(stores.read_pattern_store(spark, target))
    return flat.groupBy("status").agg(F.count("*").alias("patterns"), F.sum("use_count").alias("uses"))


def get_pattern(spark, sf) -> DataFrame:
    """The document of the fingerprint of the part with the largest key."""
    key = rel.table(spark, sf, "part").agg(F.max("p_partkey").alias("k"))
    fp = key.select(_fingerprint(F.col("k") * 3).alias("f")).first()["f"]
    doc = stores.get_pattern(spark, _store(spark, sf), fp)
    return doc.select("fingerprint", F.col("fitness.use_count").alias("use_count"), F.size("fitness.fitness_history").alias("history"))


def attestation_files(spark, sf) -> DataFrame:
    """Chains written as JSON lines, read back and verified."""
    path = scratch(spark, "attest")
    stores.write_attestations(_chain(spark, sf), path)
    return attest.verify_chain(stores.read_attestations(spark, path))


def append_fitness_log(spark, sf) -> DataFrame:
    """The log of successes and of failures, appended one after the other."""
    path = scratch(spark, "log")
    u = _uses(spark, sf)
    state = patterns.fitness_fold(u).join(u.select("use_id", "used_at", "success"), "use_id")
    log = patterns.fitness_log(state)
    stores.append_fitness_log(log.filter("success"), path)
    stores.append_fitness_log(log.filter("not success"), path)
    back = spark.read.schema(log.schema).json(path)
    return back.groupBy("fingerprint").agg(F.count("*").alias("entries"), F.max("use_count").alias("use_count"), F.count_if("success").alias("successes"))


def export_facts_json(spark, sf) -> DataFrame:
    path = scratch(spark, "facts")
    counts = files.file_counts(_catalog(spark, sf))
    camel = counts.toDF(*["".join(p.capitalize() if i else p for i, p in enumerate(c.split("_"))) for c in counts.columns])
    stores.export_facts_json(camel, path)
    return spark.read.schema(counts.schema).json(path)


def user_patterns(spark, sf) -> DataFrame:
    """The detection table extended by a user's row, for the secrets the built-in patterns do not know."""
    table = signals.pii_patterns_table(spark)
    extra = spark.createDataFrame(
        [(0, "user-hex-token", r"\b[0-9a-f]{40}\b", "SECRET", "API_KEY", "HIGH", 99, None, None, "Hex token", "", True, True, None)], table.schema
    )
    pats = signals.pii_patterns_from_table(table.unionByName(extra))
    scrubbed = pii.scrub(rel.pii_texts(spark, sf), ["doc_id"], patterns=pats)
    hits = pii.detections(scrubbed, ["doc_id"])
    return hits.groupBy("pattern_id").agg(F.count("*").alias("hits"))


# ---------------------------------------------------------------- streams


def _stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream: a folder of part files is watched itself, a single file by its name in the folder above."""
    schema = rel.table(spark, sf, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run(spark, stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over what is there and read its output.  With the ``path`` of an earlier run it goes on from there."""
    path = path or scratch(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_scrub(spark, sf) -> DataFrame:
    out = _run(spark, jobs.stream_scrub(_stream(spark, sf, "documents").select("doc_id", "text"), ["doc_id"]), "scrub")
    return out.select("doc_id", "scrubbed", "payload_hash", F.size("detections").cast("long").alias("hits"))


def _use_stream(spark, sf) -> DataFrame:
    e = _stream(spark, sf, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fingerprint"), F.col("event_id").alias("use_id"), F.col("ts").cast("timestamp").alias("used_at"),
        (F.col("event_type") != "error").alias("success"), F.least(F.col("value") / 500, F.lit(1.0)).alias("savings"),
    )


def stream_fitness(spark, sf) -> DataFrame:
    return _run(spark, jobs.stream_fitness(_use_stream(spark, sf), "60 days"), "fitness")


def stream_fitness_ordered(spark, sf) -> DataFrame:
    """The uses that the watermark has passed when all events are read: those five days older than the newest event."""
    jobs.use_state_store(spark)
    return _run(spark, jobs.stream_fitness_ordered(_use_stream(spark, sf), "5 days"), "fitness")


def stream_attest(spark, sf) -> DataFrame:
    path = scratch(spark, "audit")
    write = jobs.attest_batch(f"{path}/out", "doc_id", "analyst", "documents", "HEAD")
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return attest.verify_chain(spark.read.parquet(f"{path}/out"))


def stream_attest_by_source(spark, sf) -> DataFrame:
    """One chain per source over a stream of three batches, verified by chain alone.  A batch is what was written since the one before,
    in as many files as its rows have partitions."""
    path = scratch(spark, "sourced")
    docs = rel.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    jobs.use_state_store(spark)
    try:
        for part in range(3):
            docs.where(F.pmod("doc_id", F.lit(3)) == part).write.parquet(f"{path}/in/batch={part}")
            stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
            chained = jobs.stream_chain(stream, "source", "doc_id", "analyst", F.lit("documents"), F.lit("HEAD"), F.lit(DETECTED_AT))
            linked = _run(spark, chained, "chains", f"{path}/run")
        return attest.verify_chain(linked)
    finally:
        spark.conf.unset(jobs.STATE_STORE[0])


QUERIES = {
    f.__name__: f
    for f in (
        scan_and_read_files, scan_paths, read_pattern_store, upsert_pattern, get_pattern, attestation_files, append_fitness_log,
        export_facts_json, user_patterns, stream_scrub, stream_fitness, stream_fitness_ordered, stream_attest, stream_attest_by_source,
    )
}
