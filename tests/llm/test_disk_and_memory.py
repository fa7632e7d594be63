"""What the steps leave on disk and send to Python."""

import time

import numpy as np
from pyspark.sql import functions as F

from factloom.functions.checkpoints import CLEANUP, cut, stored
from factloom.llm import ngram_join, toxicity


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_written_steps_leave_no_shuffle_files(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count()
    set_to, before = spark.conf.get(CLEANUP, None), _shuffle_files(spark)
    kept = [cut(rows), stored(rows, "rows")]
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == set_to
    assert [df.agg(F.sum("count")).first()[0] for df in kept] == [1000, 1000]


def test_a_text_goes_to_python_once(spark, monkeypatch):
    seen = []
    score = toxicity.score
    monkeypatch.setattr(toxicity, "score", lambda rows, *a, **k: seen.append(rows.schema.simpleString()) or score(rows, *a, **k))
    docs = spark.createDataFrame([(i, "vile rotten filth" if i % 2 else "kind words of praise", 0.5) for i in range(60)] + [(60, None, None)], "doc_id long, text string, `a.b` double")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).where("doc_id < 60")
    out = toxicity.keep_harmless(docs, labels, F.lit(True), threshold=2.0)
    assert out.schema == docs.schema and seen[0].count("text:string") == 1
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()}


def test_bitmaps_of_large_sets_bound_their_overlap():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 12_000, dtype=np.int64).astype(np.uint64)
    pairs = [(np.arange(4000), np.arange(2000, 6000)), (np.arange(900), np.arange(100, 1100)), (np.arange(5000), np.arange(400, 4400)), (np.arange(3), np.arange(3)), (np.arange(12_000), np.arange(12_000))]
    tokens = [pool[side] for pair in pairs for side in pair]
    bits = ngram_join._bitmaps(np.concatenate(tokens), np.array([len(t) for t in tokens]))
    assert [len(b) * 8 for b in bits[:4]] == [4096, 4096, 1024, 1024]
    differing = ngram_join._differing(bits[::2], bits[1::2])
    for (x, y), d in zip(pairs, differing.tolist()):
        assert (len(x) + len(y) - d) // 2 >= len(np.intersect1d(x, y))
    # a third in common: 1024 bits for each set, half of them set by chance, let this pair through
    assert not 7 * ((8000 - int(differing[0])) // 2) >= 3 * 8000
    assert ngram_join._differing([], []).tolist() == []
