"""Findings, dimension scores, grades and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.numbers import ceil_div
from factloom.functions.ranking import ordinal


def _typed(variant: str, path: str, kind: str) -> Column:
    """A member of a parsed JSON value when it has the wanted JSON type, else NULL."""
    value = f"variant_get({variant}, '$.{path}')"
    wanted = {"string": "= 'STRING'", "double": "RLIKE '^(BIGINT|DOUBLE|DECIMAL)'", "boolean": "= 'BOOLEAN'"}[kind]
    return F.expr(f"CASE WHEN schema_of_variant({value}) {wanted} THEN try_variant_get({variant}, '$.{path}', '{kind}') END")


def _or(col: Column, default) -> Column:
    return F.coalesce(col, F.lit(default))


def validate_findings(df: DataFrame, payload: str) -> DataFrame:
    """JSON findings: dropped without text severity, description and file; the rest get defaults."""
    v = df.withColumn("_v", F.try_parse_json(payload))
    keep = [c for c in df.columns if c != payload]
    rows = v.select(
        *keys_of(keep), _typed("_v", "severity", "string").alias("severity"), _typed("_v", "dimension", "string").alias("dimension"),
        _typed("_v", "description", "string").alias("description"), _typed("_v", "file", "string").alias("file"),
        _or(_typed("_v", "lineStart", "double"), 0.0).alias("line_start"), _or(_typed("_v", "lineEnd", "double"), 0.0).alias("line_end"),
        _or(_typed("_v", "detail", "string"), "").alias("detail"), _or(_typed("_v", "fix", "string"), "").alias("fix"),
        _or(_typed("_v", "deduction", "double"), 0.0).alias("deduction"),
    )
    return rows.filter("severity is not null and description is not null and file is not null")


def keys_of(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def validate_dimensions(df: DataFrame, payload: str) -> DataFrame:
    v = df.withColumn("_v", F.try_parse_json(payload))
    rows = v.select(
        *keys_of([c for c in df.columns if c != payload]), _typed("_v", "dimension", "string").alias("dimension"),
        _typed("_v", "grade", "string").alias("grade"), _or(_typed("_v", "score", "double"), 0.0).alias("score"),
        _or(_typed("_v", "active", "boolean"), True).alias("active"),
    )
    return rows.filter("dimension is not null and grade is not null")


def validate_uncertain(df: DataFrame, payload: str) -> DataFrame:
    v = df.withColumn("_v", F.try_parse_json(payload))
    rows = v.select(
        *keys_of([c for c in df.columns if c != payload]), _typed("_v", "file", "string").alias("file"),
        _or(_typed("_v", "lineStart", "double"), 0.0).alias("line_start"), _or(_typed("_v", "lineEnd", "double"), 0.0).alias("line_end"),
        _or(_typed("_v", "trigger", "string"), "").alias("trigger"), _or(_typed("_v", "confidencePct", "double"), 0.0).alias("confidence_pct"),
        _or(_typed("_v", "recommendedAction", "string"), "").alias("recommended_action"),
    )
    return rows.filter("file is not null")


def severity_filter(findings: DataFrame, severity: str = "all") -> DataFrame:
    return findings if severity == "all" else findings.filter(F.col("severity") == severity)


def letter_grade(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, F.lit(grade)) for grade, least in signals.GRADES], F.lit("F"))


def dimension_score(findings: DataFrame, start: float = 100.0) -> DataFrame:
    """max(0, start - sum of deductions) per (repo_id, dimension)."""
    out = findings.groupBy("repo_id", "dimension").agg(F.greatest(F.lit(0.0), F.lit(start) - F.sum("deduction")).alias("score"))
    return out.withColumn("grade", letter_grade(F.col("score")))


def _weight(table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for name, weight in table.items() for x in (name, float(weight))]
    return _or(F.try_element_at(F.create_map(*pairs), F.col("dimension")), 0.0)


def overall_score(dimensions: DataFrame) -> DataFrame:
    """Weighted mean over active dimensions; without an active Compliance its weight goes to the others."""
    active = F.col("active")
    with_c = _weight(signals.DIMENSION_WEIGHTS)
    without = _weight(signals.DIMENSION_WEIGHTS_NO_COMPLIANCE)

    def mean(weight: Column) -> Column:
        return F.sum(F.when(active, weight * F.col("score"))) / F.nullif(F.sum(F.when(active, weight)), F.lit(0.0))

    agg = dimensions.groupBy("repo_id").agg(
        F.bool_or(active & (F.col("dimension") == "Compliance")).alias("_c"), mean(with_c).alias("_w"), mean(without).alias("_o")
    )
    raw = F.when(F.col("_c"), F.col("_w")).otherwise(F.col("_o"))
    score = F.coalesce(F.floor(raw + 0.5), F.lit(100).cast("long"))
    return agg.select("repo_id", score.alias("overall_score"), letter_grade(score).alias("overall_grade"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """P0-P3 counts and the label 'n P0, m P1' per (repo_id, dimension)."""
    out = findings.groupBy("repo_id", "dimension").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in signals.SEVERITIES]
    )
    pieces = [F.when(F.col(s.lower()) > 0, F.concat(F.col(s.lower()).cast("string"), F.lit(f" {s}"))) for s in signals.SEVERITIES]
    label = F.concat_ws(", ", *pieces)
    return out.withColumn("label", F.when(label == "", F.lit("—")).otherwise(label))


def order_findings(findings: DataFrame, block: int = 100_000) -> DataFrame:
    """Position of each finding in its severity section: deduction descending, then input order.

    A repository may hold most findings, so positions come from per-block totals (see ``ranking.ordinal``): the
    bucket is (deduction, block of input ordinals), which never decreases along the order.
    """
    bucket = F.struct((-F.col("deduction")).alias("d"), F.floor(F.col("ord") / block).alias("b"))
    return ordinal(findings, ["repo_id", "severity"], bucket, [F.col("ord")], "position")


# ---------------------------------------------------------------- token cost


def token_cost(messages: DataFrame, key: str, text: str, chars_per_token: int = 4, prices=signals.MODEL_PRICES) -> DataFrame:
    """Estimated tokens per conversation and their cost under every model of the (fixed) price table."""
    totals = messages.groupBy(key).agg(F.sum(ceil_div(F.length(text), chars_per_token)).alias("input_tokens"))
    totals = totals.withColumn("output_tokens", F.ceil(F.col("input_tokens") * 0.3).cast("long"))
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o"), F.lit("fast" if fast else "thorough").alias("approach"))
        for m, i, o, fast in prices
    ])
    each = totals.select("*", F.explode(models).alias("m"))
    cost = (F.col("input_tokens") * F.col("m.i") + F.col("output_tokens") * F.col("m.o")) / 1_000_000
    return each.select(key, "m.model", "m.approach", "input_tokens", "output_tokens", cost.alias("cost_usd"))


def dense_tokens(text: Column) -> Column:
    """Estimate for dense text: three characters per token."""
    return ceil_div(F.length(text), 3)
