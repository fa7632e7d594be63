"""Queries of fingerprints, matching, fitness, learning, scores, costs and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings import relations as rel
from factloom.functions.numbers import round_half_up
from factloom.operators import embed, patterns, scoring

LANGS = ("typescript", "python", "go", "java", "ruby")
FRAMEWORKS = ("hono", "express", "nextjs", "nuxt", "fastapi", "flask", "rails", "unknown", "spring")
ORMS = ("drizzle", "prisma", "typeorm", "sqlalchemy", "tortoise", "unknown")
AUTHS = ("jwt", "session", "oauth", "unknown")
DEPLOYS = ("docker", "nginx", "kubernetes", "helm", "unknown", "vercel")
AS_OF = "2024-03-15 00:00:00"


def _pick(values, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def _fingerprint(key: Column) -> Column:
    return F.concat_ws(
        "+", _pick(LANGS, key), _pick(FRAMEWORKS, F.floor(key / 5)), _pick(ORMS, F.floor(key / 7)), _pick(AUTHS, F.floor(key / 3)),
        _pick(DEPLOYS, F.floor(key / 11)),
    )


def _patterns(spark, sf) -> DataFrame:
    """One stored pattern per part."""
    k = F.col("p_partkey")
    uses = (k % 13).cast("long")
    return rel.table(spark, sf, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("pattern_id"), _fingerprint(k * 3).alias("fingerprint"), k.alias("store_ord"),
        F.when(k % 10 == 0, F.lit("deprecated")).when(k % 3 == 0, F.lit("probation")).otherwise(F.lit("active")).alias("status"),
        uses.alias("use_count"), F.least(uses, (k % 4).cast("long")).alias("probation_uses"), F.least(uses, (k % 7).cast("long")).alias("success_count"),
        ((k % 90) / 100.0).alias("avg_savings"), ((k % 101) / 100.0).alias("fitness_score"),
        F.when(k % 5 > 0, F.date_add(F.lit("2023-09-01").cast("date"), (k % 190).cast("int")).cast("timestamp_ntz")).alias("last_used_at"),
    )


def _queries(spark, sf) -> DataFrame:
    """One query fingerprint per customer; some are shorter than the stored ones."""
    k = F.col("c_custkey")
    full = _fingerprint(k * 7 + 1)
    return rel.table(spark, sf, "customer").select(
        k.alias("query_id"), F.when(k % 9 == 0, F.substring_index(full, "+", 4)).otherwise(full).alias("fingerprint")
    )


def segment_normalize(spark, sf) -> DataFrame:
    p = rel.table(spark, sf, "part")
    raw = F.concat(F.col("p_type"), F.lit(" - "), F.col("p_brand"), F.lit("."), F.col("p_size").cast("string"), F.lit("_"))
    return p.select("p_partkey", patterns.segment_normalize(raw).alias("segment"), patterns.normalize_fingerprint(F.concat_ws("+", "p_brand", "p_name", F.lit(""))).alias("fingerprint"))


def fingerprint(spark, sf) -> DataFrame:
    p = rel.table(spark, sf, "part")
    k = F.col("p_partkey")
    targets = F.filter(F.array(_pick(("Docker", "Vercel", "Heroku", "Nginx box", "My VPS", "Fly.io"), k), F.when(k % 4 == 0, F.lit("Vercel"))), lambda t: t.isNotNull())
    targets = F.when(k % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(targets)
    deploy = patterns.deployment_segment(k % 6 == 0, k % 2 == 0, targets)
    fp = patterns.fingerprint(
        _pick(("TypeScript", "C#", "Go 1.21", "Unknown", ""), k), _pick(("Next.js", "Spring Boot", "FastAPI", "Ruby on Rails", "@nestjs/core", ""), k),
        _pick(("drizzle-orm", "@prisma/client", "SQLAlchemy 2.0", "Django ORM", ""), F.floor(k / 2)), _pick(("jwt", "magic_link", "custom"), k), deploy,
    )
    return p.select("p_partkey", fp.alias("fingerprint"))


def segment_similarity(spark, sf) -> DataFrame:
    """Every stored pattern against the base stack."""
    base = F.lit("typescript+hono+drizzle+jwt+docker")
    return _patterns(spark, sf).select("pattern_id", patterns.fingerprint_similarity(F.col("fingerprint"), base).alias("similarity"), patterns.fingerprint_similarity(F.col("fingerprint"), F.lit("typescript+hono")).alias("similarity_short"))


def eligible_patterns(spark, sf) -> DataFrame:
    return patterns.eligible(_patterns(spark, sf)).select("pattern_id", "fingerprint", "status")


def pattern_exact_match(spark, sf) -> DataFrame:
    return patterns.exact_match(_queries(spark, sf), _patterns(spark, sf))


def pattern_fuzzy_match(spark, sf) -> DataFrame:
    out = patterns.fuzzy_match(_queries(spark, sf), _patterns(spark, sf), threshold=0.85)
    return out.withColumn("match_score", round_half_up(F.col("match_score"), 4))


def pattern_fuzzy_match_wide(spark, sf) -> DataFrame:
    """A lower threshold, at which two segments may differ."""
    out = patterns.fuzzy_match(_queries(spark, sf), _patterns(spark, sf), threshold=0.75)
    return out.withColumn("match_score", round_half_up(F.col("match_score"), 4))


def query_patterns(spark, sf) -> DataFrame:
    """The default threshold, at which a five-segment fingerprint matches exactly or not at all."""
    return patterns.query_patterns(_queries(spark, sf), _patterns(spark, sf))


# ---------------------------------------------------------------- fitness


def _uses(spark, sf) -> DataFrame:
    return rel.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fingerprint"), F.col("event_id").alias("use_id"), F.col("ts").alias("used_at"),
        (F.col("event_type") != "error").alias("success"), F.least(F.col("value") / 500, F.lit(1.0)).alias("savings"),
    )


def fitness_score(spark, sf) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    c = F.col
    return _patterns(spark, sf).select(
        "pattern_id", patterns.recency(c("last_used_at"), as_of).alias("recency"),
        patterns.fitness_score(c("success_count"), c("use_count"), c("avg_savings"), c("last_used_at"), as_of).alias("fitness"),
    )


def fitness_totals(spark, sf) -> DataFrame:
    return patterns.fitness_totals(_uses(spark, sf), F.lit(AS_OF).cast("timestamp_ntz")).drop("last_used_at")


def fitness_running(spark, sf) -> DataFrame:
    return patterns.fitness_running(_uses(spark, sf), F.to_date("used_at"))


def fitness_update(spark, sf) -> DataFrame:
    return patterns.fitness_fold(_uses(spark, sf))


def promote_deprecate(spark, sf) -> DataFrame:
    u = _uses(spark, sf)
    state = patterns.fitness_fold(u).join(u.select("use_id", "used_at"), "use_id")
    # a stricter limit than the default, so that runs of low scores occur
    return patterns.promote_deprecate(state, F.lit(AS_OF).cast("timestamp_ntz"), low=0.68, run=3)


def fitness_log(spark, sf) -> DataFrame:
    u = _uses(spark, sf)
    state = patterns.fitness_fold(u).join(u.select("use_id", "used_at", "success"), "use_id")
    return patterns.fitness_log(state)


def pattern_index(spark, sf) -> DataFrame:
    return patterns.pattern_index(_patterns(spark, sf))


def pattern_totals(spark, sf) -> DataFrame:
    return patterns.pattern_totals(_patterns(spark, sf))


# ---------------------------------------------------------------- findings and learning

DIMS = ("Security", "Compliance", "Testability", "Observability", "Maintainability", "Documentation", "Scalability")


def _findings(spark, sf) -> DataFrame:
    """One finding per order; severity from the order priority."""
    k = F.col("o_orderkey")
    sev = F.when(F.col("o_orderpriority").startswith("1"), F.lit("P0")).when(F.col("o_orderpriority").startswith("2"), F.lit("P1")).when(F.col("o_orderpriority").startswith("3"), F.lit("P2")).otherwise(F.lit("P3"))
    kind = (k % 40).cast("string")
    text = F.concat(F.lit("Missing control "), kind, F.lit(" in src/o"), kind, F.lit(".ts lines 10-12:7 of module"))
    ded = F.when(sev == "P0", F.lit(25.0)).when(sev == "P1", F.lit(15.0)).when(sev == "P2", F.lit(8.0)).otherwise(F.lit(3.0))
    return rel.spread(rel.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(
        F.concat(F.lit("repo-"), F.col("o_custkey").cast("string")).alias("repo_id"), _pick(DIMS, k).alias("dimension"), sev.alias("severity"),
        text.alias("description"), F.concat(F.lit("src/o"), k.cast("string"), F.lit("/l1.ts")).alias("file"), (ded + k % 3).alias("deduction"), k.alias("ord"),
    )


def _finding_json(spark, sf) -> DataFrame:
    """Findings as JSON text, some with missing or mistyped members, some not JSON at all."""
    f = _findings(spark, sf)
    k = F.col("ord")
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = F.concat_ws(
        ",",
        F.when(k % 11 != 0, member("severity", quoted(F.col("severity")))), F.when(k % 13 != 0, member("description", quoted(F.col("description")))),
        member("file", F.when(k % 17 == 0, F.lit("5")).otherwise(quoted(F.col("file")))), member("dimension", quoted(F.col("dimension"))),
        F.when(k % 2 == 0, member("lineStart", F.when(k % 4 == 0, F.lit('"12"')).otherwise((k % 100).cast("string")))),
        F.when(k % 3 == 0, member("deduction", F.lit("7.5"))), F.when(k % 5 == 0, member("detail", quoted(F.lit("see")))),
    )
    doc = F.when(k % 19 == 0, F.lit("not json {")).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    return f.select("repo_id", "ord", doc.alias("payload"))


def validate_findings(spark, sf) -> DataFrame:
    return scoring.validate_findings(_finding_json(spark, sf), "payload")


def validate_dimensions(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    doc = F.concat(
        F.lit('{"dimension":'), F.when(k % 7 == 0, F.lit("null")).otherwise(F.lit('"Security"')), F.lit(',"grade":"B"'),
        F.when(k % 2 == 0, F.concat(F.lit(',"score":'), (k % 101).cast("string"))).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit(',"active":false')).otherwise(F.lit("")), F.lit("}"),
    )
    return scoring.validate_dimensions(rel.table(spark, sf, "customer").select(k.alias("report_id"), doc.alias("payload")), "payload")


def validate_uncertain(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    doc = F.concat(
        F.lit('{'), F.when(k % 6 == 0, F.lit('"name":1')).otherwise(F.concat(F.lit('"file":"f'), k.cast("string"), F.lit('"'))),
        F.when(k % 2 == 0, F.lit(',"confidencePct":55,"trigger":"t"')).otherwise(F.lit(',"confidencePct":"high"')), F.lit("}"),
    )
    return scoring.validate_uncertain(rel.table(spark, sf, "customer").select(k.alias("report_id"), doc.alias("payload")), "payload")


def severity_filter(spark, sf) -> DataFrame:
    return scoring.severity_filter(_findings(spark, sf), "P0").select("repo_id", "ord", "severity")


def dimension_score(spark, sf) -> DataFrame:
    return scoring.dimension_score(_findings(spark, sf))


def _dimensions(spark, sf) -> DataFrame:
    """Scored dimensions; Compliance counts only in every second repository."""
    scores = scoring.dimension_score(_findings(spark, sf))
    n = F.regexp_extract("repo_id", r"\d+", 0).cast("long")
    active = (F.col("dimension") != "Compliance") | (n % 2 == 0)
    return scores.withColumn("active", active & (n % 50 != 0))


def overall_score(spark, sf) -> DataFrame:
    return scoring.overall_score(_dimensions(spark, sf))


def letter_grade(spark, sf) -> DataFrame:
    score = F.col("c_custkey") % 101
    return rel.table(spark, sf, "customer").select("c_custkey", score.alias("score"), scoring.letter_grade(score).alias("grade"))


def severity_counts(spark, sf) -> DataFrame:
    return scoring.severity_counts(_findings(spark, sf))


def findings_by_severity(spark, sf) -> DataFrame:
    return scoring.order_findings(_findings(spark, sf)).select("repo_id", "severity", "ord", "deduction", "position")


def sanitize_text(spark, sf) -> DataFrame:
    texts = rel.spread(rel.table(spark, sf, "documents").select("doc_id", "text"))
    return texts.select("doc_id", F.sha2(patterns.sanitize_text(F.col("text")), 256).alias("clean_hash")).unionByName(
        _findings(spark, sf).select((-F.col("ord") - 1).alias("doc_id"), patterns.sanitize_text(F.col("description")).alias("clean_hash"))
    )


def content_fence(spark, sf) -> DataFrame:
    raw = _findings(spark, sf).select("ord", F.to_json(F.struct("file", "description")).alias("doc"), F.lit("raw").alias("form"))
    clean = _findings(spark, sf).select("ord", F.to_json(F.struct(patterns.sanitize_text(F.col("description")).alias("description"))).alias("doc"), F.lit("clean").alias("form"))
    return raw.unionByName(clean).select("ord", "form", patterns.content_fence(F.col("doc")).alias("rule"))


def _sightings(spark, sf) -> DataFrame:
    """Gap sightings per fingerprint from the event log: one use per day, a gap per event type."""
    e = rel.table(spark, sf, "events")
    day = F.dayofmonth("ts").cast("long")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fingerprint"), F.lit("Security").alias("dimension"), F.col("event_type").alias("gap"), day.alias("use_no")
    ).distinct()


def gap_frequency(spark, sf) -> DataFrame:
    return patterns.gap_frequency(_sightings(spark, sf))


def gap_frequency_total(spark, sf) -> DataFrame:
    return patterns.gap_frequency_total(_sightings(spark, sf))


def _stored_gaps(spark, sf) -> DataFrame:
    """Stored gaps: per repository, the odd kinds of controls."""
    kinds = F.sequence(F.lit(1), F.lit(39), F.lit(2))
    keys = rel.spread(rel.table(spark, sf, "customer").select("c_custkey"))
    c = keys.select(F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("fingerprint"), F.explode(kinds).alias("kind"))
    text = patterns.sanitize_text(F.concat(F.lit("Missing control "), F.col("kind").cast("string"), F.lit(" in [source-file] [location] of module")))
    return c.select("fingerprint", _pick(DIMS, F.col("kind")).alias("dimension"), text.alias("gap"), F.lit("P2").alias("severity"), (F.col("kind") / 40.0).alias("frequency"))


def _merged(spark, sf) -> DataFrame:
    found = _findings(spark, sf).withColumnRenamed("repo_id", "fingerprint")
    uses = rel.table(spark, sf, "customer").select(
        F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("fingerprint"), (F.col("c_custkey") % 9 + 1).alias("use_count")
    )
    return patterns.merge_gaps(_stored_gaps(spark, sf), found, uses)


def merge_gaps(spark, sf) -> DataFrame:
    return _merged(spark, sf)


def top_gaps(spark, sf) -> DataFrame:
    return patterns.top_gaps(_merged(spark, sf), 3)


def learn_pattern(spark, sf) -> DataFrame:
    """Every query is a use of its fingerprint; existing state is the best stored pattern of the fingerprint."""
    from factloom.functions.ranking import first_per_key

    stored = first_per_key(
        _patterns(spark, sf).select("fingerprint", "pattern_id", "status", "use_count", "probation_uses", "success_count", "avg_savings", "fitness_score", "store_ord"),
        ["fingerprint"], [F.col("store_ord")],
    ).drop("store_ord")
    return patterns.learn_pattern(_queries(spark, sf), stored, F.lit(AS_OF).cast("timestamp_ntz")).drop("last_used_at")


def learned_document(spark, sf) -> DataFrame:
    """Whole documents of users who learn from all their events, one row per gap; every second customer has a document already."""
    from factloom.operators import learning

    now = F.lit(AS_OF).cast("timestamp_ntz")
    uses = rel.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fingerprint"))
    found = _sightings(spark, sf).select("fingerprint", "dimension", F.col("gap").alias("description"), F.lit("P1").alias("severity"), (F.col("use_no") + 9).alias("use_no"))
    k = F.col("c_custkey")
    c = rel.table(spark, sf, "customer").select(F.concat(F.lit("u"), k.cast("string")).alias("fingerprint"), k)
    history = F.array(F.struct(F.lit("2023-01-01").alias("date"), F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("use_count")))
    gap = F.struct(F.lit("Security").alias("dimension"), F.lit("error").alias("gap"), F.lit("P2").alias("severity"), (k % 40 / 40.0).alias("frequency"))
    old = F.struct(F.lit("Testability").alias("dimension"), F.lit("no tests").alias("gap"), F.lit("P3").alias("severity"), F.lit(0.25).alias("frequency"))
    existing = c.where(k % 2 == 0).select(
        "fingerprint", F.concat(F.lit("p"), k.cast("string")).alias("pattern_id"), F.lit("probation").alias("status"), (k % 9 + 1).alias("use_count"), F.lit(0).cast("long").alias("probation_uses"),
        (k % 9 + 1).alias("success_count"), (k % 97 / 97.0).alias("avg_savings"), F.lit(0.5).alias("fitness_score"), now.alias("created_at"), history.alias("history"), F.array(gap, old).alias("gaps"),
    )
    test = F.concat(F.lit("unit tests"), F.when(k % 50 == 0, F.lit(", ask root@example.com")).otherwise(F.lit("")))
    stack = c.select("fingerprint", *[(test if name == "test_pattern" else F.lit(None).cast("string")).alias(name) for name in learning.STACK])
    documents = learning.learned_documents(uses, existing, found, stack, now)
    rows = documents.select("fingerprint", "status", "fitness", "rejected", F.col("stack_patterns.test_pattern").alias("test_pattern"), F.explode("common_gaps").alias("g"))
    return rows.select(
        "fingerprint", "status", "fitness.use_count", "fitness.avg_savings", "fitness.fitness_score", F.size("fitness.history").cast("long").alias("history_entries"), "test_pattern",
        F.col("rejected").isNotNull().alias("is_rejected"), "g.dimension", "g.gap", "g.severity", "g.frequency",
    )


def stack_summary(spark, sf) -> DataFrame:
    c = rel.table(spark, sf, "customer").select(F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("repo_id"), F.col("c_custkey").alias("k"))
    entries = c.select("repo_id", F.posexplode(F.array(F.lit("server"), F.lit("cli"), F.lit("server"))).alias("ord", "entry_type")).withColumn("description", F.concat(F.lit("starts src/"), F.col("entry_type"), F.lit(".ts")))
    layers = c.select("repo_id", F.posexplode(F.array(F.lit("api"), F.lit("data"))).alias("ord", "name")).withColumn("responsibility", F.concat(F.lit("handles "), F.col("name"), F.lit(" at line 5"))).filter(F.col("repo_id") != "repo-0")
    k = F.col("k")
    stack = c.select(
        "repo_id", F.when(k % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("PostgreSQL"), F.lit("Redis"))).alias("engines"),
        F.when(k % 2 == 0, F.lit("Prisma")).alias("orm"), F.when(k % 5 > 0, F.lit("jwt + session in src/auth.ts")).alias("auth"), F.lit("unit tests in tests/unit").alias("testing"),
        F.when(k % 4 == 0, F.lit("Kubernetes")).alias("orchestration"), F.when(k % 7 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("Docker"), F.lit("Make"))).alias("ci_tools"),
    )
    return patterns.stack_summary(entries, layers, stack)


# ---------------------------------------------------------------- costs and embeddings


def token_cost(spark, sf) -> DataFrame:
    return scoring.token_cost(rel.table(spark, sf, "conversations"), "conv_id", "text")


def dense_tokens(spark, sf) -> DataFrame:
    t = rel.table(spark, sf, "conversations")
    return t.groupBy("conv_id").agg(F.sum(scoring.dense_tokens(F.col("text"))).alias("tokens"))


def _vector_facts(df: DataFrame, key: str) -> DataFrame:
    """A vector as comparable scalars: its size, norm, an index-weighted sum and all values to nine digits as one hash."""
    v = F.col("v")
    digits = F.transform(v, lambda x: F.floor(x * 1e9 + 0.5).cast("long").cast("string"))
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return df.select(
        key, F.size(v).alias("dims"), round_half_up(norm, 6).alias("squared_norm"), round_half_up(weighted, 4).alias("weighted_sum"),
        F.sha2(F.array_join(digits, ","), 256).alias("values_hash"),
    )


def hash_embed(spark, sf) -> DataFrame:
    docs = rel.spread(rel.table(spark, sf, "documents").select("doc_id", "text"))
    return _vector_facts(docs.select("doc_id", embed.hash_embed("text").alias("v")), "doc_id")


def normalize_dim(spark, sf) -> DataFrame:
    e = rel.spread(rel.table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return _vector_facts(e.select("vec_id", embed.normalize_dim(F.col("embedding")).alias("v")), "vec_id")


def normalize_dim_down(spark, sf) -> DataFrame:
    """To fewer dimensions, by averaging neighbours."""
    e = rel.spread(rel.table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return _vector_facts(e.select("vec_id", embed.normalize_dim(F.col("embedding"), 24).alias("v")), "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        segment_normalize, fingerprint, segment_similarity, eligible_patterns, pattern_exact_match, pattern_fuzzy_match,
        pattern_fuzzy_match_wide, query_patterns, fitness_score, fitness_totals, fitness_running, fitness_update, promote_deprecate,
        fitness_log, pattern_index, pattern_totals, validate_findings, validate_dimensions, validate_uncertain, severity_filter,
        dimension_score, overall_score, letter_grade, severity_counts, findings_by_severity, sanitize_text, content_fence,
        gap_frequency, gap_frequency_total, merge_gaps, top_gaps, learn_pattern, learned_document, stack_summary, token_cost, dense_tokens, hash_embed,
        normalize_dim, normalize_dim_down,
    )
}
