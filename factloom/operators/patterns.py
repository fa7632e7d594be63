"""Stack fingerprints, the store of learned patterns, matching and learning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.arrays import let
from factloom.functions.folds import ordered_fold, round4
from factloom.functions.numbers import round_half_up
from factloom.functions.ranking import running_sums, top_k_per_group
from factloom.functions.regex import sql_literal, to_java, trim_ws
from factloom.operators.files import lookup

VALID_KEY = r"^[a-zA-Z0-9_+\-.#]{1,256}\z"


# ---------------------------------------------------------------- fingerprints


def segment_normalize(value: Column) -> Column:
    """Lower case, version digits removed, separators trimmed at the end and collapsed; empty is 'unknown'."""
    ws = to_java(r"[-_.\s]+$")
    inner = to_java(r"[-_\s]+")
    out = F.regexp_replace(F.lower(value), r"\d+(?:\.\d+)*", "")
    out = F.regexp_replace(F.regexp_replace(out, ws, ""), inner, "-")
    return F.when(value.isNull() | value.isin("", "unknown") | (out == ""), F.lit("unknown")).otherwise(out)


def _alias(aliases: dict[str, str], value: Column) -> Column:
    return F.coalesce(lookup(aliases, F.lower(trim_ws(value))), segment_normalize(value))


def deployment_segment(kubernetes: Column, dockerfile: Column, targets: Column) -> Column:
    def mentions(word: str) -> Column:
        return F.exists(targets, lambda t: F.lower(t).contains(word))

    first = F.lower(F.try_element_at(targets, F.lit(1)))
    bare = F.when(first.isNull(), F.lit("unknown"))
    for word in ("vercel", "heroku", "nginx", "vps"):
        bare = bare.when(first.contains(word), F.lit(word))
    return (
        F.when(kubernetes, F.lit("kubernetes"))
        .when(dockerfile & mentions("vercel"), F.lit("vercel"))
        .when(dockerfile & mentions("heroku"), F.lit("heroku"))
        .when(dockerfile, F.lit("docker"))
        .otherwise(bare.otherwise(segment_normalize(first)))
    )


def fingerprint(language: Column, framework: Column, orm: Column, auth: Column, deployment: Column) -> Column:
    """language+framework+orm+auth+deployment; ``deployment`` is already a segment."""
    first_word = F.regexp_extract(framework, to_java(r"^(\S*)"), 1)
    fw = F.when(framework.isNull() | (framework == ""), F.lit("unknown")).otherwise(_alias(signals.FRAMEWORK_ALIASES, first_word))
    om = F.when(orm.isNull() | (orm == ""), F.lit("unknown")).otherwise(_alias(signals.ORM_ALIASES, orm))
    au = F.when(auth.isNull(), F.lit("unknown")).otherwise(F.coalesce(lookup(signals.AUTH_ALIASES, auth), auth))
    return F.concat_ws("+", segment_normalize(language), fw, om, au, deployment)


def normalize_fingerprint(fp: Column) -> Column:
    return F.array_join(F.transform(F.split(fp, r"\+", -1), segment_normalize), "+")


def segment_similarity(a: Column, b: Column) -> Column:
    related = F.lit(False)
    for group in signals.RELATED_SEGMENTS:
        related = related | (a.isin(*group) & b.isin(*group))
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "unknown") | (b == "unknown"), F.lit(signals.SIMILARITY_UNKNOWN))
        .when(related, F.lit(signals.SIMILARITY_RELATED))
        .otherwise(F.lit(0.0))
    )


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """Mean segment similarity; missing segments count as 'unknown'."""
    sa, sb = F.split(a, r"\+", -1), F.split(b, r"\+", -1)
    n = F.greatest(F.size(sa), F.size(sb))
    pairs = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: segment_similarity(
            F.coalesce(F.try_element_at(sa, i), F.lit("unknown")), F.coalesce(F.try_element_at(sb, i), F.lit("unknown"))
        ),
    )
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / n


# ---------------------------------------------------------------- matching


def eligible(patterns: DataFrame) -> DataFrame:
    return patterns.filter(F.col("status") != "deprecated")


def exact_match(queries: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query columns, pattern_id, match_score, match_type): the first eligible pattern with the same fingerprint."""
    first = eligible(patterns).groupBy("fingerprint").agg(F.min_by("pattern_id", "store_ord").alias("pattern_id"))
    hit = queries.join(first, "fingerprint")
    return hit.select(*queries.columns, "pattern_id", F.lit(1.0).alias("match_score"), F.lit("exact").alias("match_type"))


def _options(seg: str) -> str:
    """SQL: ways in which another segment may differ from ``seg``, with the similarity lost.

    '*' stands for any segment: an unknown segment is 0.3 similar to every other one, and any two segments are at
    least 0 similar.  Related values and 'unknown' are enumerated, which makes every candidate an equality key.
    """
    groups = ", ".join("array(" + ", ".join(sql_literal(x) for x in g) + ")" for g in signals.RELATED_SEGMENTS)
    related = f"array_except(array_distinct(flatten(filter(array({groups}), g -> array_contains(g, {seg})))), array({seg}))"
    return f"""concat(
      transform({related}, r -> named_struct('v', r, 'loss', {1 - signals.SIMILARITY_RELATED}D)),
      CASE WHEN {seg} <> 'unknown' THEN array(named_struct('v', 'unknown', 'loss', {1 - signals.SIMILARITY_UNKNOWN}D))
           ELSE array(named_struct('v', '*', 'loss', {1 - signals.SIMILARITY_UNKNOWN}D)) END,
      array(named_struct('v', '*', 'loss', 1.0D)))"""


def fuzzy_match(queries: DataFrame, patterns: DataFrame, threshold: float = signals.MATCH_THRESHOLD, max_segments: int | None = None) -> DataFrame:
    """Best eligible pattern at or above ``threshold`` per query fingerprint; ties go to the fittest, then to store order.

    No pair of fingerprints is compared.  A similarity of at least t over n segments leaves a budget of (1 - t) * n to
    lose and every differing segment costs at least 0.5, so at most d = floor((1 - t) * n / 0.5) segments differ.  Each
    distinct query fingerprint is expanded to the keys within its budget; stored fingerprints are reduced to the best
    pattern per key (their own form, and the forms with up to d segments masked).  The join returns at most one row per
    key.  Fingerprints of different length are padded with 'unknown' to the longer one; ``max_segments`` (the longest
    fingerprint of both sides) is looked up when it is not given.
    """
    if max_segments is None:
        sizes = queries.select("fingerprint").unionByName(patterns.select("fingerprint"))
        max_segments = sizes.agg(F.max(F.size(F.split("fingerprint", r"\+", -1)))).first()[0] or 1
    budget = (1.0 - threshold) * max_segments
    d = int(math.floor(budget / (1 - signals.SIMILARITY_RELATED) + 1e-9))

    def padded(df: DataFrame) -> DataFrame:
        """One row per total length: the native one, and longer ones padded with 'unknown'."""
        seg = F.split("fingerprint", r"\+", -1)
        fits = F.size(seg) <= max_segments
        size = F.when(fits, F.size(seg)).otherwise(F.raise_error(F.lit("fingerprint longer than max_segments")).cast("int"))
        sized = df.withColumn("_seg", seg).withColumn("_own", size)
        grown = sized.withColumn("_n", F.explode(F.sequence(F.col("_own"), F.lit(max_segments))))
        pad = F.concat("_seg", F.array_repeat(F.lit("unknown"), F.col("_n") - F.col("_own")))
        return grown.withColumn("_seg", pad).withColumn("_native", F.col("_own") == F.col("_n")).drop("_own")

    best = eligible(patterns).groupBy("fingerprint").agg(
        F.min_by(F.struct("fitness_score", "store_ord", "pattern_id"), F.struct((-F.col("fitness_score")).alias("f"), F.col("store_ord"))).alias("p")
    )
    stored = padded(best).selectExpr("_seg", "_n", "_native", "p", "0 AS _last", "0 AS _masked")
    masks = stored
    for _ in range(d):
        open_ = masks.filter(F.col("_last") < F.col("_n"))
        grown = open_.select("*", F.explode(F.sequence(F.col("_last") + 1, F.col("_n"))).alias("_i"))
        masks = grown.select(
            F.expr("transform(_seg, (s, i) -> CASE WHEN i = _i - 1 THEN '*' ELSE s END)").alias("_seg"), "_n", "_native", "p",
            F.col("_i").alias("_last"), (F.col("_masked") + 1).alias("_masked"),
        )
        stored = stored.unionByName(masks)
    order = F.struct((-F.col("p.fitness_score")).alias("f"), F.col("p.store_ord").alias("o"))
    keys = stored.groupBy(F.array_join("_seg", "+").alias("_key"), "_n", "_native").agg(F.min_by("p", order).alias("p"))

    distinct = queries.select("fingerprint").distinct()
    wanted = padded(distinct).selectExpr("fingerprint", "_seg", "_n", "_native AS _q_native", "0 AS _last", "0.0D AS _loss")
    frontier = wanted
    limit = F.lit(1.0 - threshold) * F.col("_n") + F.lit(1e-9)
    for _ in range(d):
        at = frontier.filter(F.col("_last") < F.col("_n")).select("*", F.explode(F.sequence(F.col("_last") + 1, F.col("_n"))).alias("_i"))
        opened = at.withColumn("_s", F.expr("element_at(_seg, _i)")).select("*", F.explode(F.expr(_options("_s"))).alias("_o"))
        frontier = opened.select(
            "fingerprint", F.expr("transform(_seg, (s, i) -> CASE WHEN i = _i - 1 THEN _o.v ELSE s END)").alias("_seg"), "_n", "_q_native",
            F.col("_i").alias("_last"), (F.col("_loss") + F.col("_o.loss")).alias("_loss"),
        ).filter(F.col("_loss") <= limit)
        wanted = wanted.unionByName(frontier)
    candidates = wanted.select("fingerprint", F.array_join("_seg", "+").alias("_key"), "_n", "_q_native", "_loss")
    joined = candidates.join(keys, ["_key", "_n"]).filter("_native OR _q_native")
    scored = joined.withColumn("match_score", F.lit(1.0) - F.col("_loss") / F.col("_n"))
    rank = F.struct(F.round(F.col("match_score"), 9).alias("s"), F.col("p.fitness_score").alias("f"), (-F.col("p.store_ord")).alias("o"))
    winner = scored.groupBy("fingerprint").agg(F.max_by(F.struct("p.pattern_id", "match_score"), rank).alias("w"))
    return queries.join(winner, "fingerprint").select(*queries.columns, "w.pattern_id", "w.match_score", F.lit("fuzzy").alias("match_type"))


def query_patterns(queries: DataFrame, patterns: DataFrame, threshold: float = signals.MATCH_THRESHOLD) -> DataFrame:
    """Exact match, else fuzzy match, else none.  The fuzzy step sees only what the equality join left over."""
    exact = exact_match(queries, patterns)
    keys = [c for c in queries.columns]
    left = queries.join(exact.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*keys)
    fuzzy = fuzzy_match(left, patterns, threshold)
    none = left.join(fuzzy.select("fingerprint").distinct(), "fingerprint", "left_anti").select(
        *keys, F.lit(None).cast("string").alias("pattern_id"), F.lit(0.0).alias("match_score"), F.lit("none").alias("match_type")
    )
    return exact.unionByName(fuzzy).unionByName(none)


# ---------------------------------------------------------------- fitness


def days_between(earlier: Column, later: Column) -> Column:
    """Days with fraction between two timestamps, without time zone."""
    ntz = "timestamp_ntz"
    return F.timestamp_diff("MICROSECOND", earlier.cast(ntz), later.cast(ntz)) / F.lit(86_400_000_000.0)


def recency(last_used: Column, as_of: Column) -> Column:
    days = days_between(last_used, as_of)
    return (
        F.when(last_used.isNull(), F.lit(0.1)).when(days < 30, F.lit(1.0)).when(days < 90, F.lit(0.7))
        .when(days < 180, F.lit(0.4)).otherwise(F.lit(0.1))
    )


def fitness_score(successes: Column, uses: Column, savings: Column, last_used: Column, as_of: Column) -> Column:
    """0.6 success rate + 0.3 savings + 0.1 recency, four decimals."""
    rate = F.when(uses > 0, successes / uses).otherwise(F.lit(0.0))
    return round_half_up(rate * 0.6 + savings * 0.3 + recency(last_used, as_of) * 0.1, 4)


def fitness_totals(uses: DataFrame, as_of: Column) -> DataFrame:
    """Final state per fingerprint from combinable aggregates (average savings rounded once, at the end)."""
    agg = uses.groupBy("fingerprint").agg(
        F.count("*").alias("use_count"), F.count_if("success").alias("success_count"),
        F.sum(F.col("savings").cast("decimal(20,6)")).alias("_sum"), F.max("used_at").alias("last_used_at"),
    )
    avg = round_half_up(F.col("_sum").cast("double") / F.col("use_count"), 4)
    return agg.withColumn("avg_savings", avg).drop("_sum").withColumn(
        "fitness_score", fitness_score(F.col("success_count"), F.col("use_count"), F.col("avg_savings"), F.col("last_used_at"), as_of)
    )


def fitness_running(uses: DataFrame, bucket: Column) -> DataFrame:
    """State after every use from running sums, split by (fingerprint, ``bucket``) so that one busy fingerprint is
    spread; average savings are rounded at output only."""
    sums = {
        "use_count": F.lit(1).cast("long"), "success_count": F.col("success").cast("long"),
        "savings_sum": F.col("savings").cast("decimal(20,6)"),
    }
    ran = running_sums(uses, ["fingerprint"], bucket, [F.col("used_at"), F.col("use_id")], sums)
    avg = F.col("savings_sum").cast("double") / F.col("use_count")
    score = F.col("success_count") / F.col("use_count") * 0.6 + avg * 0.3 + F.lit(0.1)
    return ran.select(
        "fingerprint", "use_id", "use_count", "success_count", round_half_up(avg, 4).alias("avg_savings"),
        round_half_up(score, 4).alias("fitness_score"),
    )


def fold_step(state, success: bool, savings: float):
    """One use: (uses, probation uses, successes, average savings, score, status) -> the next one."""
    uses, probation, successes, average, score, status = state
    new_uses, new_successes = uses + 1, successes + (1 if success else 0)
    new_probation = probation + 1 if status == "probation" else probation
    new_average = round4((average * uses + savings) / new_uses if uses > 0 else savings)
    new_score = round4(new_successes / new_uses * 0.6 + new_average * 0.3 + 0.1)
    if status == "probation" and new_probation >= 3 and new_successes > 0:
        status = "active"
    return new_uses, new_probation, new_successes, new_average, new_score, status


FOLD_START = (0, 0, 0, 0.0, 0.0, "probation")


def fitness_fold(uses: DataFrame) -> DataFrame:
    """State after every use with the average rounded at every step, as the pattern document stores it, and the
    history entry (score and count before the use).  Recency is that of the use itself."""

    def step(state, row):
        new = fold_step(state, bool(row["success"]), float(row["savings"]))
        return new, (row["use_id"], *new, state[4], state[0])

    schema = (
        "use_id long, use_count long, probation_uses long, success_count long, avg_savings double, fitness_score double, "
        "status string, history_score double, history_use_count long"
    )
    narrow = uses.select("fingerprint", "used_at", "use_id", "success", "savings")
    return ordered_fold(narrow, ["fingerprint"], [F.col("used_at"), F.col("use_id")], lambda: FOLD_START, step, schema)


def promote_deprecate(history: DataFrame, as_of: Column, low: float = 0.4, run: int = 5, idle_days: int = 180) -> DataFrame:
    """Status changes per fingerprint from its use history (``use_count`` numbers the uses).

    The run of low scores at the end is the distance between the last use and the last use that was not low, so a
    run-length needs no window: two combinable maxima.
    """
    last = F.max_by(F.struct("fitness_score", "success_count", "probation_uses", "status", "used_at"), "use_count")
    agg = history.groupBy("fingerprint").agg(
        F.max("use_count").alias("use_count"), last.alias("l"),
        F.coalesce(F.max(F.when(F.col("fitness_score") >= low, F.col("use_count"))), F.lit(0)).alias("_good"),
    )
    low_run = F.col("use_count") - F.col("_good")
    idle = days_between(F.col("l.used_at"), as_of)
    probation, active = F.col("l.status") == "probation", F.col("l.status") == "active"
    promote = probation & (F.col("l.probation_uses") >= 3) & (F.col("l.success_count") > 0)
    deprecate = (probation & (F.col("use_count") >= 5) & (F.col("l.success_count") == 0)) | (
        active & (((low_run >= run) & (F.col("l.fitness_score") < low)) | (idle >= idle_days))
    )
    return agg.select(
        "fingerprint", "use_count", F.col("l.status").alias("status"), low_run.alias("low_run"),
        promote.alias("should_promote"), deprecate.alias("should_deprecate"),
    )


def fitness_log(state: DataFrame) -> DataFrame:
    """One log row per use."""
    return state.select(
        F.date_format("used_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("use_id").alias("entry_id"), "fingerprint",
        "use_count", "fitness_score", F.col("avg_savings").alias("token_savings_pct"), "success",
    )


def pattern_index(patterns: DataFrame) -> DataFrame:
    """Index rows with a label, to be ordered by fitness descending (a range-partitioned sort)."""
    last = F.coalesce(F.date_format("last_used_at", "yyyy-MM-dd"), F.lit("—"))
    return patterns.select(
        "pattern_id", "fingerprint", F.initcap("status").alias("status"), round_half_up(F.col("fitness_score"), 2).alias("fitness"),
        "use_count", last.alias("last_used"),
    )


def pattern_totals(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("status").agg(F.count("*").alias("patterns"), F.sum("use_count").alias("uses"))


# ---------------------------------------------------------------- learning


def sanitize_text(text: Column) -> Column:
    """Replace source file names, paths and line references; drop ':n' suffixes."""
    for i, (rx, flags, replacement) in enumerate(signals.SANITIZE_RULES):
        # only the first rule begins with something else than a word character
        text = F.regexp_replace(text, to_java(rx, flags, word_start=i > 0), replacement.replace("$", r"\$"))
    return trim_ws(text)


def content_fence(document: Column) -> Column:
    """1-based number of the first structural pattern in a serialized document, NULL when clean."""
    hits = [
        F.when(document.rlike(to_java(rx, flags)), F.lit(i)) for i, (rx, flags) in enumerate(signals.FENCE_REGEXES, 1)
    ]
    return F.coalesce(*hits)


def gap_frequency(sightings: DataFrame) -> DataFrame:
    """Frequency of a gap after each sighting, rounded at every step.

    ``sightings``: (fingerprint, dimension, gap, use_no).  f <- (f * (u - 1) + 1) / u when seen at use u, starting at 1 / u.
    """

    def step(f, row):
        u = int(row["use_no"])
        new = round4(1.0 / u if f is None else (f * (u - 1) + 1) / u)
        return new, (u, new)

    narrow = sightings.select("fingerprint", "dimension", "gap", "use_no")
    return ordered_fold(narrow, ["fingerprint", "dimension", "gap"], [F.col("use_no")], lambda: None, step, "use_no long, frequency double")


def gap_frequency_total(sightings: DataFrame) -> DataFrame:
    """The same frequency in closed form, f = 1 - prod((u - 1) / u), as a combinable sum of logarithms; within 1e-4 of
    :func:`gap_frequency` per rounding step, and safe for a gap that holds most rows."""
    log = F.when(F.col("use_no") > 1, F.log((F.col("use_no") - 1) / F.col("use_no"))).otherwise(F.lit(0.0))
    return sightings.groupBy("fingerprint", "dimension", "gap").agg(
        F.count("*").alias("sightings"), F.sum(log).alias("_log"), F.bool_or(F.col("use_no") == 1).alias("_first")
    ).select(
        "fingerprint", "dimension", "gap", "sightings",
        round_half_up(F.when(F.col("_first"), F.lit(1.0)).otherwise(1.0 - F.exp("_log")), 4).alias("frequency"),
    )


def merge_gaps(stored: DataFrame, found: DataFrame, use_count: DataFrame) -> DataFrame:
    """Stored gaps full-outer-joined with new ones on (fingerprint, dimension, gap text).

    ``stored``: fingerprint, dimension, gap, severity, frequency; ``found``: fingerprint, dimension, description, severity;
    ``use_count``: fingerprint, use_count (including this use).  Gap text is sanitized on both sides of the key.
    Unseen gaps keep their frequency.
    """
    fresh = found.select("fingerprint", "dimension", sanitize_text(F.col("description")).alias("gap"), "severity", "ord")
    fresh = fresh.groupBy("fingerprint", "dimension", "gap").agg(F.min_by("severity", "ord").alias("new_severity"))
    both = stored.join(fresh, ["fingerprint", "dimension", "gap"], "full_outer").join(use_count, "fingerprint")
    n = F.col("use_count")
    seen = (F.col("frequency") * (n - 1) + 1) / n
    freq = (
        F.when(F.col("new_severity").isNull(), F.col("frequency"))
        .when(F.col("frequency").isNull(), round_half_up(F.lit(1.0) / n, 4))
        .otherwise(round_half_up(seen, 4))
    )
    return both.select("fingerprint", "dimension", "gap", F.coalesce("severity", "new_severity").alias("severity"), freq.alias("frequency"))


def top_gaps(gaps: DataFrame, k: int | None = 3) -> DataFrame:
    return top_k_per_group(gaps, ["fingerprint"], [F.desc("frequency"), F.asc("dimension"), F.asc("gap")], k, "gap_rank")


#: savings grow by this factor a use, up to this most; this many uses are counted step by step
GROWTH, MOST_SAVINGS, STEPS = 1.05, 0.8, 32


def savings_after(average: Column, uses: Column, more: Column) -> Column:
    """Average savings after ``more`` further uses of a pattern with ``uses`` uses, each with min(0.8, 1.05 average), not rounded.

    While the average a is under 0.8 / 1.05, a use multiplies it by (u + 1.05) / (u + 1), and the product over many uses is a quotient
    of gamma functions; beyond, every use adds 0.8 and the average is linear in what is added.  The first 32 uses are counted step by
    step, which makes the two terms of the quotient's expansion exact to nine digits.  Cost does not depend on ``more``.
    """
    few = F.least(more, F.lit(STEPS)).cast("int")

    def use(a: Column, i: Column) -> Column:
        return (a * (uses + i - 1) + F.least(F.lit(MOST_SAVINGS), a * GROWTH)) / (uses + i)

    stepped = F.aggregate(F.when(few > 0, F.sequence(F.lit(1), few)).otherwise(F.expr("cast(array() as array<int>)")), average.cast("double"), use)
    g = GROWTH - 1

    def quotient(w: Column) -> Column:
        """gamma(z + g) / gamma(z) for w = z + (g - 1) / 2."""
        return F.pow(w, F.lit(g)) * (1 - g * (g - 1) * (g + 1) / 24 / (w * w))

    def rest(a: Column) -> Column:
        u, left = (uses + few).cast("double"), (more - few).cast("double")
        w = u + 1 + (g - 1) / 2
        until = F.greatest(F.lit(0.0), F.ceil(F.least(left, w * F.pow(MOST_SAVINGS / GROWTH / a, F.lit(1 / g)) - w)).cast("double"))
        growing = F.when(a > 0, F.least(left, until)).otherwise(left)
        grown = a * quotient(w + growing) / quotient(w)
        return F.when(left > 0, (grown * (u + growing) + MOST_SAVINGS * (left - growing)) / (u + left)).otherwise(a)

    return let(stepped, rest)


def learn_pattern(uses: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """New version of the pattern of every fingerprint in ``uses``: one row per successful use, several of a fingerprint count as so many.

    Savings follow min(0.8, previous * 1.05) averaged over the uses (:func:`savings_after`), rounded once; n uses at once equal n runs
    with one use each but for the rounding of each run.  Status turns active at three probation uses.  The history entry is the state
    before the run.
    """
    j = uses.groupBy("fingerprint").agg(F.count("*").alias("_more")).join(existing, "fingerprint", "left")
    had, more = F.col("use_count").isNotNull(), F.col("_more")
    prev_uses = F.coalesce("use_count", F.lit(0))
    use_count = prev_uses + more
    successes = F.coalesce("success_count", F.lit(0)) + more
    probation = F.coalesce("probation_uses", F.lit(0)) + more
    j = j.withColumn("_savings", savings_after(F.coalesce("avg_savings", F.lit(0.0)), prev_uses, more))
    savings = F.col("_savings")
    status = F.when(F.col("status") == "active", F.lit("active")).when(probation >= 3, F.lit("active")).otherwise(F.lit("probation"))
    return j.select(
        "fingerprint", F.coalesce("pattern_id", F.left(F.sha2("fingerprint", 256), F.lit(12))).alias("pattern_id"), status.alias("status"),
        use_count.alias("use_count"), probation.alias("probation_uses"), successes.alias("success_count"),
        round_half_up(savings, 4).alias("avg_savings"),
        round_half_up(successes / use_count * 0.6 + savings * 0.3 + F.lit(0.1), 4).alias("fitness_score"),
        F.when(had, F.col("fitness_score")).alias("history_score"), F.when(had, F.col("use_count")).alias("history_use_count"),
        now.alias("last_used_at"),
    )


def stack_summary(
    entries: DataFrame, layers: DataFrame, stack: DataFrame
) -> DataFrame:
    """Generic stack description per repository.

    ``entries``: repo_id, entry_type, description (few distinct labels after sanitizing); ``layers``: repo_id, ord, name,
    responsibility (a handful per repository); ``stack``: repo_id, engines, orm, auth, testing, orchestration, ci_tools.
    """
    labels = entries.select(
        "repo_id", sanitize_text(F.concat_ws(": ", "entry_type", "description")).alias("label"), "ord"
    ).groupBy("repo_id", "label").agg(F.min("ord").alias("ord"))
    typical = labels.groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("entry_points")
    )
    arrows = layers.groupBy("repo_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", sanitize_text(F.concat_ws(": ", "name", "responsibility")).alias("t")))), lambda x: x["t"]),
            " → ",
        ).alias("layers")
    )
    with_orm = F.concat("engines", F.when(F.col("orm").isNotNull(), F.array(F.concat(F.lit("with "), F.col("orm")))).otherwise(F.expr("cast(array() as array<string>)")))
    db = F.when(F.size("engines") > 0, sanitize_text(F.array_join(with_orm, " ")))
    tools = F.array_join("ci_tools", ", ")
    infra = F.when(
        F.col("orchestration").isNotNull(),
        F.concat(F.col("orchestration"), F.when(F.size("ci_tools") > 0, F.concat(F.lit(" with "), tools)).otherwise(F.lit(""))),
    ).otherwise(tools)
    infra = sanitize_text(infra)
    return stack.join(typical, "repo_id", "left").join(arrows, "repo_id", "left").select(
        "repo_id", F.array_join("entry_points", " | ").alias("entry_points"),
        F.coalesce(F.when(F.col("layers") != "", F.col("layers")), F.lit("No layer structure identified")).alias("layers"),
        sanitize_text(F.col("auth")).alias("auth_pattern"), db.alias("db_pattern"), sanitize_text(F.col("testing")).alias("test_pattern"),
        F.when(infra != "", infra).alias("infra_pattern"),
    )
