import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bindings import q_io
from factloom.functions.checkpoints import scratch
from factloom.operators import attest, patterns, pii
from factloom.sources import files as file_source
from factloom.streaming import jobs

USES = "fingerprint string, use_id long, used_at timestamp, success boolean, savings double"


def test_stream_state_across_batches(spark):
    src, out = scratch(spark, "src"), scratch(spark, "out")
    rows = spark.sql("select 'f' fingerprint, id use_id, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) used_at, id % 3 <> 0 success, id / 20 savings from range(12)")
    rows = rows.withColumn("savings", F.col("savings").cast("double"))
    for lo, hi in ((0, 5), (5, 12)):
        rows.filter(f"use_id >= {lo} and use_id < {hi}").coalesce(1).write.mode("append").parquet(src)
    rows.filter("use_id = 3").coalesce(1).write.mode("append").parquet(src)  # a repeated use
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.stream_fitness(stream, "60 days").writeStream.format("parquet").option("path", out + "/o").option("checkpointLocation", out + "/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out + "/o").orderBy("use_count").collect()
    want = patterns.fitness_fold(rows).orderBy("use_count").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 12


def test_shuffled_uses_come_out_in_order(spark):
    jobs.use_state_store(spark)
    src, out = scratch(spark, "src"), scratch(spark, "out")
    rows = spark.sql("select concat('f', id % 3) fingerprint, id use_id, timestamp'2024-01-01' + make_interval(0,0,0,0,cast(id div 2 as int)) used_at, id % 4 <> 0 success, cast(id / 60 as double) savings from range(60)")
    rows = rows.cache()
    # newest first, each file again, ties in time, then a late use and one that moves the watermark beyond all others
    for lo in (40, 20, 0, 20):
        rows.filter(f"use_id >= {lo} and use_id < {lo + 20}").coalesce(1).write.mode("append").parquet(src)
    for i in (998, 999):  # the first moves the watermark, the batch of the second releases and is the last one before late uses are dropped
        spark.sql(f"select 'end' fingerprint, {i}L use_id, timestamp'2024-02-01' used_at, true success, 1D savings").coalesce(1).write.mode("append").parquet(src)
    spark.sql("select 'f0' fingerprint, 1000L use_id, timestamp'2024-01-01' used_at, true success, 1D savings union all select null, 1L, timestamp'2024-02-01', true, 1D").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.stream_fitness_ordered(stream, "3 days").writeStream.format("parquet").option("path", out + "/o").option("checkpointLocation", out + "/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out + "/o").orderBy("fingerprint", "use_count").collect()
    want = patterns.fitness_fold(rows).orderBy("fingerprint", "use_count").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == 60


def test_scan_and_read(spark, tmp_path):
    for rel, data in {"one/src/a.py": b"x = 1\n", "one/node_modules/b.js": b"1", "two/c.bin": b"\0" * 50, "two/bad.txt": b"ok \xff"}.items():
        os.makedirs((tmp_path / rel).parent, exist_ok=True)
        (tmp_path / rel).write_bytes(data)
    got = {(r.repo_id, r.path): (r.content, r.is_binary, r.size_bytes) for r in file_source.read_text(file_source.scan_files(spark, str(tmp_path))).collect()}
    assert got == {("one", "src/a.py"): ("x = 1\n", False, 6), ("two", "c.bin"): (None, True, 50), ("two", "bad.txt"): ("ok �", False, 4)}


def test_streams_read_tables_of_one_file_and_of_a_folder(spark, tmp_path):
    docs = [(i, f"mail a{i}@b.org" if i % 2 else "none", "en", "s", 1) for i in range(8)]
    events = [(i, "2024-01-01 00:00:00", i % 2, "view", 1.0, "{}") for i in range(8)]
    for sf in ("one", "many"):
        for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                                   ("events", events, "event_id long, ts string, user_id long, event_type string, value double, props string")):
            df = spark.createDataFrame(rows, schema)
            if sf == "many":
                df.repartition(3).write.parquet(f"{tmp_path}/{sf}/{name}.parquet")
            else:
                df.toPandas().to_parquet(f"{os.makedirs(tmp_path / sf, exist_ok=True) or tmp_path / sf}/{name}.parquet")
    one, many = (str(tmp_path / sf) for sf in ("one", "many"))
    for query in (q_io.stream_attest, q_io.stream_scrub, q_io.stream_fitness):
        got = [sorted(map(str, query(spark, sf).collect())) for sf in (one, many)]
        assert got[0] == got[1] and len(got[0]) == {q_io.stream_attest: 4}.get(query, 8)


def test_batches_of_documents_are_not_gathered_in_one_file(spark, tmp_path, monkeypatch):
    docs = [(i, f"mail a{i}@b.org", "en", ["s", "t", None][i % 4 % 3], 1) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    roots = []
    monkeypatch.setattr(q_io, "scratch", lambda s, name: roots.append(scratch(s, name)) or roots[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = {r.chain_id: (r.entries, r.valid) for r in q_io.stream_attest_by_source(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"s": (12, True), "t": (6, True), "": (6, True)}
    root = roots[0].removeprefix("file:")
    files = [[f for f in os.listdir(f"{root}/in/batch={part}") if f.endswith(".parquet")] for part in range(3)]
    assert all(len(f) > 1 for f in files)
    assert sorted(f for f in os.listdir(f"{root}/run/state/commits") if f.isdigit())[:3] == ["0", "1", "2"]


def test_invalid_key_is_refused(spark, tmp_path):
    from factloom.sources import stores

    with pytest.raises(ValueError):
        stores.get_pattern(spark, str(tmp_path), "../etc")


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    df = entry.entry(spark)
    assert df.columns == ["category", "pii_type", "hits", "chars_replaced"] and df.count() > 0


@pytest.mark.parametrize("name", ["scrub_value", "overall_score", "env_inventory", "hub_files", "pattern_fuzzy_match", "token_cost"])
def test_query_against_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)

    def norm(row):
        return tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)

    got = sorted(norm(r) for r in df.select(*cols).collect())
    assert got == sorted(norm(r) for r in rel.select(*cols).fetchall())


def test_pattern_store_newest_wins(spark, sf):
    rows = q_io.read_pattern_store(spark, sf)
    assert rows.count() == rows.select("fingerprint").distinct().count() > 0


def test_a_payload_in_two_batches_has_a_valid_chain_in_each(spark):
    out = scratch(spark, "chains")
    write = jobs.attest_batch(out, "id", "me", "r", "c")
    batch = spark.createDataFrame([(1, "ssn 123-45-6789 and 987-65-4321, mail a.b@example.com")], "id long, text string")
    write(batch, 0)
    write(batch, 1)
    write(batch, 1)  # repeated after a failure
    entries = spark.read.parquet(out)
    got = attest.verify_chain(entries, ("chain_id", "batch")).collect()
    assert {(r.chain_id, r.batch, r.valid) for r in got} == {(1, 0, True), (1, 1, True)}
    assert len({r.entries for r in got}) == 1


def _chain_texts(spark, n):
    rows = [(i, ["r1", "r1", "r1", "r2", None][i % 5], "none" if i % 7 == 6 else f"mail a{i}@b.org and 10.0.0.{i % 200}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, repo string, text string")


def test_one_chain_goes_on_over_payloads_and_blocks(spark):
    texts = _chain_texts(spark, 120).repartition(5)

    def entries(df):
        return attest.unlinked_entries(pii.scrub(df, ["id"], carry=["repo"]), "repo", "id", "me", F.lit("r"), F.lit("c"), F.lit("2024"))

    whole = attest.linked_chain(entries(texts)).orderBy("chain_id", "chain_seq").collect()
    assert [tuple(r) for r in attest.linked_chain(entries(texts), block=7).orderBy("chain_id", "chain_seq").collect()] == [tuple(r) for r in whole]
    for chain in ("r1", "r2", None):
        own = [r for r in whole if r.chain_id == chain]
        assert [r.chain_seq for r in own] == list(range(1, len(own) + 1))
        assert [(r.payload, r.place) for r in own] == sorted((r.payload, r.place) for r in own)
        prev = attest.GENESIS
        for r in own:
            body = {js: r[name] for js, name, _ in attest.ENTRY_FIELDS}
            assert r.prev_hash == prev and r.this_hash == _sha(body)
            prev = _sha({**body, "thisHash": r.this_hash})
    first = attest.linked_chain(entries(texts.where("id < 50")), block=11)
    later = attest.linked_chain(entries(texts.where("id >= 50")), attest.chain_heads(first), block=11)
    both = first.unionByName(later)
    assert sorted(map(str, both.collect())) == sorted(map(str, whole))
    assert all(r.valid for r in attest.verify_chain(both).collect())
    lost = attest.verify_chain(both.where("not (chain_id <=> 'r1' and chain_seq = 30)")).where("not valid").collect()
    assert [(r.chain_id, r.first_error) for r in lost] == [("r1", "Entry 31: chainSeq out of order")]
    none = attest.linked_chain(entries(texts.limit(0)))
    assert none.count() == 0 and set(none.columns) == set(both.columns)


def _sha(body):
    return "sha256:" + hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_one_chain_goes_on_over_batches_and_a_repeated_batch_changes_nothing(spark):
    src, out = scratch(spark, "src"), scratch(spark, "out")
    texts = _chain_texts(spark, 60).where("repo is not null")
    for part in range(3):
        texts.where(f"id % 3 = {part}").coalesce(1).write.parquet(f"{src}/batch={part}")

    def run():
        stream = spark.readStream.schema(texts.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
        chained = jobs.stream_chain(stream, "repo", "id", "me", F.lit("r"), F.lit("c"), F.lit("2024"))
        q = chained.writeStream.format("parquet").option("path", f"{out}/o").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(str, spark.read.parquet(f"{out}/o").collect()))

    jobs.use_state_store(spark)
    try:
        once = run()
        entries = spark.read.parquet(f"{out}/o")
        got = attest.verify_chain(entries).collect()
        assert all(r.valid for r in got) and {r.chain_id: r.entries for r in got} == {r.repo: r["count"] for r in (
            pii.detections(pii.scrub(texts, ["id"], carry=["repo"]), ["repo"]).groupBy("repo").count().collect())}
        # as after a failure: the last batch was written, but not committed
        commits = f"{out}/c/commits".removeprefix("file:")
        last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
        assert last == "2"
        for name in (last, f".{last}.crc"):
            if os.path.exists(f"{commits}/{name}"):
                os.remove(f"{commits}/{name}")
        assert run() == once
    finally:
        spark.conf.unset(jobs.STATE_STORE[0])
