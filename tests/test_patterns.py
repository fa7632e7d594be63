import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom import signals
from factloom.operators import embed, patterns, scoring

BASE = "typescript+hono+drizzle+jwt+docker"


def similarity(a, b):
    sa, sb = a.split("+"), b.split("+")
    n = max(len(sa), len(sb))

    def one(x, y):
        if x == y:
            return 1.0
        if "unknown" in (x, y):
            return 0.3
        return 0.5 if any(x in g and y in g for g in signals.RELATED_SEGMENTS) else 0.0

    return sum(one(x, y) for x, y in itertools.zip_longest(sa, sb, fillvalue="unknown")) / n


def test_similarity_goldens(spark):
    pairs = [(BASE, BASE), (BASE, BASE.replace("drizzle", "prisma")), ("typescript+hono", BASE), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(patterns.fingerprint_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.9, 0.58, 1.0])


@pytest.mark.parametrize("threshold", [0.92, 0.85, 0.7, 0.58])
def test_fuzzy_match_is_brute_force(spark, threshold):
    rnd = random.Random(7)
    vocab = [("ts", "py"), ("hono", "express", "nextjs", "unknown"), ("drizzle", "prisma", "unknown", "sqlalchemy", "django"), ("jwt", "session", "unknown"), ("docker", "nginx", "helm")]

    def fp():
        segs = [rnd.choice(v) for v in vocab]
        return "+".join(segs[: rnd.choice([5, 5, 5, 4, 3])])

    stored = [(f"p{i}", fp(), i, rnd.choice(["active", "active", "deprecated"]), round(rnd.random(), 2)) for i in range(60)]
    queries = [(i, fp()) for i in range(40)]
    p = spark.createDataFrame(stored, "pattern_id string, fingerprint string, store_ord int, status string, fitness_score double")
    q = spark.createDataFrame(queries, "query_id int, fingerprint string")
    want = {}
    for i, f in queries:
        scored = [(round(similarity(f, s[1]), 9), s[4], -s[2], s[0]) for s in stored if s[3] != "deprecated"]
        best = max((x for x in scored if x[0] >= threshold - 1e-9), default=None)
        if best:
            want[i] = (best[3], best[0])
    got = {r.query_id: (r.pattern_id, round(r.match_score, 9)) for r in patterns.fuzzy_match(q, p, threshold).collect()}
    assert got == want


def test_default_threshold_needs_equality(spark):
    p = spark.createDataFrame([("p", BASE, 1, "active", 0.9)], "pattern_id string, fingerprint string, store_ord int, status string, fitness_score double")
    q = spark.createDataFrame([(1, BASE), (2, BASE.replace("drizzle", "prisma"))], "query_id int, fingerprint string")
    assert {r.query_id: (r.match_type, r.match_score) for r in patterns.query_patterns(q, p).collect()} == {1: ("exact", 1.0), 2: ("none", 0.0)}


def test_fingerprint_parts(spark):
    df = spark.createDataFrame([("TypeScript", "Next.js", "drizzle-orm", "magic_link", ["Vercel"]), ("C#", None, None, None, [])], "l string, f string, o string, a string, t array<string>")
    deploy = patterns.deployment_segment(F.lit(False), F.lit(True), F.col("t"))
    got = [r[0] for r in df.select(patterns.fingerprint(F.col("l"), F.col("f"), F.col("o"), F.col("a"), deploy)).collect()]
    assert got == ["typescript+nextjs+drizzle+magic-link+vercel", "c#+unknown+unknown+unknown+docker"]


def test_recency_steps(spark):
    days = [0, 29, 30, 89, 90, 179, 180]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d int")
    as_of = F.lit("2024-12-31 00:00:00").cast("timestamp")
    used = F.when(F.col("d").isNotNull(), F.timestamp_add("DAY", -F.col("d"), as_of))
    assert [r[0] for r in df.select(patterns.recency(used, as_of)).collect()] == [1.0, 1.0, 0.7, 0.7, 0.4, 0.4, 0.1, 0.1]


def test_fold_promotes_and_keeps_history(spark):
    rows = [("f", i, f"2024-01-0{i + 1} 00:00:00", i != 1, 0.3) for i in range(4)]
    uses = spark.createDataFrame(rows, "fingerprint string, use_id long, at string, success boolean, savings double").withColumn("used_at", F.col("at").cast("timestamp"))
    out = patterns.fitness_fold(uses).orderBy("use_count").collect()
    assert [r.status for r in out] == ["probation", "probation", "active", "active"]
    assert [r.history_use_count for r in out] == [0, 1, 2, 3] and out[1].history_score == out[0].fitness_score
    assert out[-1].fitness_score == pytest.approx(0.75 * 0.6 + 0.3 * 0.3 + 0.1)
    run = patterns.fitness_running(uses, F.to_date("used_at")).orderBy("use_count").collect()
    assert [r.fitness_score for r in run] == pytest.approx([r.fitness_score for r in out], abs=1e-4)


def test_deprecation_rules(spark):
    def history(fp, scores, status, successes):
        return [(fp, i + 1, s, successes, 1, status, "2024-01-01 00:00:00") for i, s in enumerate(scores)]

    rows = history("never", [0.1] * 5, "probation", 0) + history("low", [0.9] + [0.3] * 5, "active", 3) + history("short", [0.9] + [0.3] * 4, "active", 3)
    df = spark.createDataFrame(rows, "fingerprint string, use_count long, fitness_score double, success_count long, probation_uses long, status string, used_at string")
    got = {r.fingerprint: (r.low_run, r.should_deprecate) for r in patterns.promote_deprecate(df, F.lit("2024-01-02 00:00:00")).collect()}
    assert got == {"never": (5, True), "low": (5, True), "short": (4, False)}
    idle = patterns.promote_deprecate(df, F.lit("2024-06-29 00:00:00")).filter("fingerprint = 'short'").first()
    assert idle.should_deprecate


def test_gap_frequency_closed_form(spark):
    df = spark.createDataFrame([("f", "Security", "g", u) for u in (2, 3, 7, 8)], "fingerprint string, dimension string, gap string, use_no long")
    last = patterns.gap_frequency(df).orderBy(F.desc("use_no")).first().frequency
    assert last == pytest.approx(patterns.gap_frequency_total(df).first().frequency, abs=4e-4)
    assert patterns.gap_frequency(df).orderBy("use_no").first().frequency == 0.5


def test_sanitize_and_fence(spark):
    cases = {
        "Missing test in src/app.ts lines 10-12": "Missing test in [source-file] [location]", "see packages/core/x and :42": "see [path] and", "Node stays": "Node stays",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(patterns.sanitize_text(F.col("t"))).collect()] == list(cases.values())
    docs = spark.createDataFrame([('{"a":"src/x"}',), ('{"a":"lib/util.py"}',), ('{"a":"Node.js"}',)], "d string")
    assert [r[0] for r in docs.select(patterns.content_fence(F.col("d"))).collect()] == [1, 4, None]


def test_scores(spark):
    schema = "repo_id string, dimension string, severity string, deduction double, ord long"
    f = spark.createDataFrame([("r", "Security", "P0", 25.0, 1), ("r", "Security", "P1", 15.0, 2), ("r", "Testability", "P0", 120.0, 3)], schema)
    got = {r.dimension: (r.score, r.grade) for r in scoring.dimension_score(f).collect()}
    assert got == {"Security": (60.0, "C"), "Testability": (0.0, "F")}
    assert {r.dimension: r.label for r in scoring.severity_counts(f).collect()} == {"Security": "1 P0, 1 P1", "Testability": "1 P0"}
    grades = spark.createDataFrame([(s,) for s in (100, 90, 89, 75, 74, 60, 59, 40, 39, 0)], "s int").select(scoring.letter_grade(F.col("s")))
    assert "".join(r[0] for r in grades.collect()) == "AABBCCDDFF"
    dims = list(signals.DIMENSION_WEIGHTS)
    rows = [("all", d, 80.0, True) for d in dims] + [("noc", d, 80.0, d != "Compliance") for d in dims] + [("none", d, 10.0, False) for d in dims]
    overall = {r.repo_id: r.overall_score for r in scoring.overall_score(spark.createDataFrame(rows, "repo_id string, dimension string, score double, active boolean")).collect()}
    assert overall == {"all": 80, "noc": 80, "none": 100}


def test_positions_survive_a_hot_repository(spark):
    df = spark.range(5000).select(F.lit("hot").alias("repo_id"), F.lit("P0").alias("severity"), (F.col("id") % 3).cast("double").alias("deduction"), F.col("id").alias("ord"))
    got = [r.ord for r in scoring.order_findings(df, block=100).orderBy("position").collect()]
    assert got == sorted(range(5000), key=lambda i: (-(i % 3), i))


def test_embeddings(spark):
    import hashlib
    import struct

    text = "héllo"
    raw = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(192))
    want = [v / 2147483648 - 1 for v in struct.unpack(">1536i", raw)]
    norm = sum(x * x for x in want) ** 0.5
    got = spark.createDataFrame([(text,)], "t string").select(embed.hash_embed("t")).first()[0]
    assert got == pytest.approx([x / norm for x in want], abs=1e-12)
    vec = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    padded = vec.select(embed.normalize_dim(F.col("v"), 4)).first()[0]
    assert padded == pytest.approx([0.6, 0.8, 0, 0])
    assert vec.select(embed.normalize_dim(F.col("v"), 1)).first()[0] == pytest.approx([1.0])
    assert vec.select(embed.normalize_dim(F.col("v"), 2)).first()[0] == [3.0, 4.0]


def test_n_uses_equal_n_single_uses(spark):
    def plain(average, uses, more):
        for u in range(uses, uses + more):
            average = (average * u + min(0.8, average * 1.05)) / (u + 1)
        return average

    cases = [(a, u, n) for a in (0.0, 0.001, 0.3, 0.7, 0.7618, 0.7620, 0.8, 0.95) for u in (0, 1, 7, 500) for n in (1, 2, 31, 32, 33, 100, 20_000)]
    rows = spark.createDataFrame(cases, "a double, u long, n long").coalesce(1).select("*", patterns.savings_after(F.col("a"), F.col("u"), F.col("n")).alias("got")).collect()
    for r in rows:
        assert r.got == pytest.approx(plain(r.a, r.u, r.n), abs=2e-8), r
    # the number of uses costs nothing, and the average stays under its limit
    assert 0.79 < spark.range(1).select(patterns.savings_after(F.lit(0.4), F.lit(3), F.lit(10**18))).first()[0] <= 0.8

    uses = spark.createDataFrame([("new",)] * 3 + [("old",)] * 4, "fingerprint string")
    old = spark.createDataFrame([("old", "p", "probation", 2, 1, 1, 0.5, 0.55)], "fingerprint string, pattern_id string, status string, use_count long, probation_uses long, success_count long, avg_savings double, fitness_score double")
    at_once = {r.fingerprint: r for r in patterns.learn_pattern(uses, old, F.lit("2024-01-01")).collect()}
    assert (at_once["new"].use_count, at_once["new"].status, at_once["new"].history_score) == (3, "active", None)
    state = old
    for _ in range(4):
        one = patterns.learn_pattern(uses.where("fingerprint = 'old'").limit(1), state, F.lit("2024-01-01"))
        state = spark.createDataFrame(one.select(*old.columns).collect(), old.schema)
    single = state.first()
    assert single.avg_savings == pytest.approx(at_once["old"].avg_savings, abs=4e-4) and single.use_count == at_once["old"].use_count == 6
    assert (single.status, single.success_count) == (at_once["old"].status, at_once["old"].success_count)


def test_learned_documents(spark):
    from factloom.operators import learning

    uses = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "fingerprint string")
    existing = spark.createDataFrame(
        [("a", "pa", "probation", 2, 2, 2, 0.1, 0.73, "2023-01-01", [("2022-12-31", 0.7, 1)], [("Security", "No rate limit", "P1", 0.5), ("Testability", "No tests", "P2", 1.0)])],
        "fingerprint string, pattern_id string, status string, use_count long, probation_uses long, success_count long, avg_savings double, fitness_score double, created_at string, "
        "history array<struct<date:string,score:double,use_count:long>>, gaps array<struct<dimension:string,gap:string,severity:string,frequency:double>>")
    found = spark.createDataFrame(
        [("a", "Security", "No rate limit", "P0", 3), ("a", "Security", "No rate limit", "P0", 4), ("a", "Security", "No rate limit", "P3", 4), ("a", "Security", None, "P0", 4),
         ("a", "Security", "No audit", "P2", 4), ("b", "Security", "Mail root@example.com leaks", "P0", 1), ("x", "Security", "No use", "P0", 1)],
        "fingerprint string, dimension string, description string, severity string, use_no int")
    stack = spark.createDataFrame([("a", "server", "api", None, "PostgreSQL", None, None)], "fingerprint string, " + ", ".join(f"{c} string" for c in learning.STACK))
    got = {r.fingerprint: r for r in learning.learned_documents(uses, existing, found, stack, F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    f = (0.5 * 2 + 1) / 3
    f = (f * 3 + 1) / 4
    assert [tuple(g) for g in a.common_gaps] == [("Security", "No audit", "P2", 0.25), ("Security", "No rate limit", "P1", round(f, 4)), ("Testability", "No tests", "P2", 1.0)]
    assert [tuple(h) for h in a.fitness.history] == [("2022-12-31", 0.7, 1), ("2024-05-01", 0.73, 2)]
    assert (a.fitness.use_count, a.status, a.stack_patterns.db_pattern, a.rejected) == (4, "active", "PostgreSQL", None)
    assert got["b"].rejected.startswith("pii ") and got["b"].fitness.history == []
    assert got["c"].common_gaps == [] and got["c"].rejected is None and got["c"].stack_patterns is None
    empty = learning.learned_documents(uses.limit(0), existing, found, stack, F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    assert empty.count() == 0
