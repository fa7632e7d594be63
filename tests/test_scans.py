"""How often and how widely texts are scanned, and that the scans find what they did."""

import re

import pytest
from pyspark.sql import functions as F

from bindings import q_facts, q_patterns
from factloom import signals
from factloom.operators import files, inventory, pii, symbols


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def corpus(spark, rows):
    return spark.createDataFrame([("r", path, text) for path, text in rows], "repo_id string, path string, content string")


def test_symbols_need_no_fold(spark):
    go = 'package a\nimport "x"\n  import (  \n\t"f"\n "o" // c\n"no"\n func In(\n )\t\nfunc Out(a) {\nimport (\nimport (\n\t"b"\n)\n)\ntype T struct\nimport "z"\ntype t2 \ntype'
    rows = [("a.go", go), ("b.go", 'import (\n\t"open"\n\tfunc F('), ("c.go", None), ("d.go", "import (\r\n\t\"q\"\r\n)\r\nfunc C(\r"),
            ("e.ts", "export {a} from \"q\"; require(\"r\")\nconst z = async (q) => require('t')\nexport async function u (\nmodule.exports = 2")]
    table = corpus(spark, rows).withColumn("size_bytes", F.lit(1).cast("long"))
    found = symbols.source_symbols(files.catalog(table))
    got = {r.path: r for r in found.collect()}
    assert got["a.go"].imports == ["x", "f", "o", "b", "z"] and got["a.go"].functions == ["Out"] and got["a.go"].classes == ["T"] and got["a.go"].exports == ["Out", "T"]
    assert got["b.go"].imports == ["open"] and got["b.go"].functions == [] and got["d.go"].imports == ["q"] and got["d.go"].functions == ["C"]
    assert got["c.go"].imports is None and got["c.go"].exports is None
    assert got["e.ts"].imports == ["q", "r", "t"] and got["e.ts"].functions == ["z", "u"] and got["e.ts"].has_default_export
    assert "aggregate(" not in plan(found)


@pytest.mark.parametrize("query, lists", [("import_edges", []), ("leaf_files", []), ("key_modules", ["exports"]), ("entry_points", ["exports", "has_default_export"])])
def test_graphs_scan_for_the_lists_they_use(spark, sf, monkeypatch, query, lists):
    columns = {}
    real = q_facts.stored

    def watched(df, name="table"):
        columns[name] = df.columns
        return real(df, name)

    monkeypatch.setattr(q_facts, "stored", watched)
    q_facts.QUERIES[query](spark, sf)
    assert columns["symbols"] == ["repo_id", "path", "imports", *lists]


def test_gaps_are_made_by_all_cores(spark, sf):
    least = 2 * spark.sparkContext.defaultParallelism
    assert q_patterns._findings(spark, sf).rdd.getNumPartitions() >= least
    assert q_patterns._stored_gaps(spark, sf).rdd.getNumPartitions() >= least


def test_auth_types_are_scanned_for_once(spark):
    texts = {
        "jwt": ["verifyToken", "JWT.VERIFY", "bearer \t token", "Authorization: Bearer", "jose.jwtVerify", "decode_jwt"],
        "session": ["req.session", "session [", "ironSession", "request.session"],
        "oauth": ["passport.authenticate", "OAuth2", "google.oauth", "authlib.integrations"],
        "apikey": ["X-API-Key", "apikey", "api_key", "apiKey in header"],
        "magic_link": ["magic link", "passwordless", "otp token", "one time password"],
    }
    rows = [(f"{kind}{n}.py", text) for kind, found in texts.items() for n, text in enumerate(found)] + [("no.py", "def f(): pass")]
    table = corpus(spark, rows)
    got = {(r.path, r.auth_type) for r in inventory.auth_files(table).collect()}
    assert got == {
        (path, kind) for path, text in rows for kind, rxs in signals.AUTH_FILE_REGEXES if any(re.search(rx, text, re.IGNORECASE) for rx in rxs)
    } and {path for path, _ in got} == {path for path, _ in rows[:-1]}
    deps = spark.createDataFrame([("r", "passport")], "repo_id string, dep string")
    routes = spark.createDataFrame([("r", True)], "repo_id string, auth_required boolean")
    assert "Generate" not in plan(inventory.auth_inventory(table, deps, routes))


def test_line_signals_are_tested_once_per_file(spark):
    table = spark.range(4).select(F.lit("r").alias("repo_id"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("path"),
                                  F.concat(F.lit("x email\n"), F.col("id").cast("string")).alias("content"))
    for found in (pii.pii_candidates(table), pii.pii_candidate_lines(table)):
        assert found.count() == 4
        # only what the scan of a line gives may be in a filter, not the test of the whole text
        assert not [line for line in plan(found).split("\n") if "Filter" in line and "RLIKE" in line and "content" in line]
        assert not [line for line in plan(found).split("\n") if "Filter" in line and "x email" in line]


def test_first_characters():
    assert pii.first_characters(r"print\s*\(") == "p" and pii.first_characters(r"[/\\]x") == "/\\\\" and pii.first_characters(r"S(?:a|b)") == "S"
    assert not any(pii.first_characters(rx) for rx in ("a?b", "a*b", "a{0,2}b", "a|b", "[^a]b", "(a|b)", r"\d", "[a]?b", "^a"))
