import datetime
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.checkpoints import scratch
from factloom.sources import stores


def docs(spark, rows):
    """(fingerprint, pattern_id, day, status)"""
    made = [(f, p, s, datetime.datetime(2024, 1, d)) for f, p, d, s in rows]
    df = spark.createDataFrame(made, "fingerprint string, pattern_id string, status string, updated_at timestamp")
    whole = spark.createDataFrame([], stores.PATTERN_SCHEMA)
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema.fields])


def current(df):
    return {r.fingerprint: (r.pattern_id, r.status) for r in df.collect()}


def test_upserts_replace_by_key_and_lookup_agrees(spark):
    path = scratch(spark, "store")
    assert stores.read_pattern_store(spark, path).count() == 0 and stores.get_pattern(spark, path, "a").count() == 0
    stores.upsert_patterns(docs(spark, [(f"k{i}", "p1", 1, "new") for i in range(300)] + [("tie", "p1", 1, "x"), ("tie", "p2", 1, "y"), ("twice", "p9", 1, "old"), ("twice", "p1", 2, "late")]), path)
    first = current(stores.read_pattern_store(spark, path))
    assert len(first) == 302 and first["tie"] == ("p2", "y") and first["twice"] == ("p1", "late")
    before = set(stores.store_folders(spark, path))
    stores.upsert_patterns(docs(spark, [("k7", "p1", 3, "second"), ("fresh", "p1", 1, "new"), ("k8", "p0", 1, "tie loses")]), path)
    stores.upsert_patterns(docs(spark, [("k7", "p1", 4, "third")]), path)
    want = {**first, "k7": ("p1", "third"), "fresh": ("p1", "new")}
    assert current(stores.read_pattern_store(spark, path)) == want
    # only touched buckets were written again
    assert 0 < len(before - set(stores.store_folders(spark, path))) <= 3
    for key in ("k7", "k8", "fresh", "tie", "twice"):
        assert current(stores.get_pattern(spark, path, key)) == {key: want[key]}
    assert stores.get_pattern(spark, path, "absent").count() == 0


def test_lookup_reads_one_bucket(spark):
    path = scratch(spark, "store")
    stores.upsert_patterns(docs(spark, [(f"k{i}", "p", 1, "new") for i in range(500)]), path)
    found = stores.get_pattern(spark, path, "k3")
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) == 1 and len(stores.store_folders(spark, path)) > 100
    assert found.count() == 1


@pytest.mark.parametrize("key", ["../etc", "", "a b", None, "x" * 257])
def test_a_bad_key_fails_at_write(spark, key):
    path = scratch(spark, "store")
    stores.upsert_patterns(docs(spark, [("good", "p", 1, "new")]), path)
    with pytest.raises(Exception, match="invalid fingerprint"):
        stores.upsert_patterns(docs(spark, [("good", "p", 2, "later"), (key, "p", 1, "bad")]), path)
    assert current(stores.read_pattern_store(spark, path)) == {"good": ("p", "new")}


def test_a_pointer_without_success_is_not_read(spark):
    path = scratch(spark, "store")
    stores.upsert_patterns(docs(spark, [("a", "p", 1, "new")]), path)
    spark.createDataFrame([(1, "lost")], "bucket int, commit string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(f"{path}/pointer/9")
    assert current(stores.read_pattern_store(spark, path)) == {"a": ("p", "new")}
    stores.upsert_patterns(docs(spark, []), path)
    assert current(stores.read_pattern_store(spark, path)) == {"a": ("p", "new")}


def test_nested_facts_are_exported_in_snake_case(spark):
    schema = "repoId string, fileTree array<struct<fileName:string,sizeBytes:long,tags:map<string,struct<isHot:boolean>>>>, envVars struct<hasValue:boolean,rawNames:array<string>>, plain int"
    rows = [("r", [("a.ts", 3, {"keepMe": (True,)}), (None, None, None)], (None, ["A", None]), 1), (None, None, None, None)]
    facts, path = spark.createDataFrame(rows, schema), scratch(spark, "facts")
    stores.export_facts_json(facts, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {"repo_id": "r", "file_tree": [{"file_name": "a.ts", "size_bytes": 3, "tags": {"keepMe": {"is_hot": True}}}, {"file_name": None, "size_bytes": None, "tags": None}],
            "env_vars": {"has_value": None, "raw_names": ["A", None]}, "plain": 1} in lines
    back = spark.read.schema(stores.snake_type(facts.schema)).json(path)
    assert sorted(back.collect(), key=lambda r: str(r[0])) == sorted(facts.collect(), key=lambda r: str(r[0]))
    with pytest.raises(ValueError):
        stores.export_facts_json(spark.createDataFrame([((1, 2),)], "s struct<aB:int,a_b:int>"), path)
