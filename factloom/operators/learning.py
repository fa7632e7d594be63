"""The whole document of a learned pattern: fitness with history, gaps, stack patterns, and the checks before it is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.numbers import round_half_up
from factloom.operators import pii
from factloom.operators.patterns import content_fence, learn_pattern, sanitize_text

STACK = ("entry_points", "layers", "auth_pattern", "db_pattern", "test_pattern", "infra_pattern")
GAP = "struct<dimension:string,gap:string,severity:string,frequency:double>"
HISTORY = "struct<date:string,score:double,use_count:bigint>"
KEY = ["fingerprint", "dimension", "gap"]


def merge_sightings(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Gaps after any number of uses: fingerprint, dimension, gap, severity, frequency.

    ``stored``: the same columns; ``found``: fingerprint, dimension, description, severity, use_no (number of the use that saw it, from 1
    on; repeated sightings of a use count once).  A sighting at use u turns f into (f (u - 1) + 1) / u, so 1 - f is multiplied by
    (u - 1) / u: the sightings combine as a sum of logarithms, in any order, and a gap with most rows is aggregated in parts.
    The stored severity stays, else that of the earliest sighting.  A null description or dimension is no gap.
    """
    seen = found.select("fingerprint", "dimension", sanitize_text(F.col("description")).alias("gap"), "severity", "use_no").where("gap is not null and dimension is not null")
    seen = seen.groupBy(*KEY, "use_no").agg(F.min("severity").alias("severity"))
    log = F.when(F.col("use_no") > 1, F.log((F.col("use_no") - 1) / F.col("use_no"))).otherwise(F.lit(0.0))
    seen = seen.groupBy(*KEY).agg(F.min_by("severity", "use_no").alias("new_severity"), F.sum(log).alias("_log"), F.bool_or(F.col("use_no") <= 1).alias("_first"))
    missed = F.when(F.col("_first"), F.lit(0.0)).otherwise(F.exp("_log"))
    after = round_half_up(1 - (1 - F.coalesce("frequency", F.lit(0.0))) * missed, 4)
    return stored.select(*KEY, "severity", "frequency").join(seen, KEY, "full_outer").select(
        *KEY, F.coalesce("severity", "new_severity").alias("severity"), F.when(F.col("_log").isNull(), F.col("frequency")).otherwise(after).alias("frequency")
    )


def learned_documents(
    uses: DataFrame, existing: DataFrame, found: DataFrame, stack: DataFrame, now: Column, patterns: Sequence[signals.PiiPattern] = signals.PII_PATTERNS,
) -> DataFrame:
    """The new document of every fingerprint in ``uses``, as nested columns, and ``rejected``: why it must not be written, or null.

    ``existing``: fingerprint, pattern_id, status, use_count, probation_uses, success_count, avg_savings, fitness_score, created_at,
    history (array of date, score, use_count), gaps (array of dimension, gap, severity, frequency); one row per fingerprint.  ``found``
    as in :func:`merge_sightings`.  ``stack``: fingerprint and the columns of ``patterns.stack_summary``, one row per fingerprint.
    A document holds each sanitized gap of its fingerprint once, ordered by dimension and text.  A run adds one history entry: the
    state before it.  Fingerprints without stack or gaps get nulls and an empty array; gaps of fingerprints without a use are left out.

    Texts are checked one by one against the personal-data patterns, then the document's JSON against the structural fence.
    """
    learned = learn_pattern(uses, existing.drop("created_at", "history", "gaps"), now)
    before = existing.select("fingerprint", "created_at", "history", "gaps")
    stored = before.select("fingerprint", F.explode("gaps").alias("g")).select("fingerprint", "g.*")
    gaps = merge_sightings(stored, found).groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct("dimension", "gap", "severity", "frequency"))).cast(f"array<{GAP}>").alias("common_gaps"))
    both = learned.join(before.drop("gaps"), "fingerprint", "left").join(gaps, "fingerprint", "left").join(stack.select("fingerprint", F.struct(*STACK).alias("stack_patterns")), "fingerprint", "left")
    day = F.date_format("last_used_at", "yyyy-MM-dd")
    entry = F.array(F.struct(day.alias("date"), F.col("history_score").alias("score"), F.col("history_use_count").cast("long").alias("use_count")))
    none = F.expr(f"cast(array() as array<{HISTORY}>)")
    history = F.concat(F.coalesce(F.col("history").cast(f"array<{HISTORY}>"), none), F.when(F.col("history_use_count").isNotNull(), entry.cast(f"array<{HISTORY}>")).otherwise(none))
    documents = both.select(
        "fingerprint", "pattern_id", "status", F.coalesce("created_at", "last_used_at").alias("created_at"), F.col("last_used_at").alias("updated_at"),
        F.struct("use_count", "probation_uses", "success_count", "avg_savings", "fitness_score", history.alias("history")).alias("fitness"),
        "stack_patterns", F.coalesce("common_gaps", F.expr(f"cast(array() as array<{GAP}>)")).alias("common_gaps"),
    )
    texts = F.concat(F.transform("common_gaps", lambda g: g["gap"]), F.array(*[F.col(f"stack_patterns.{c}") for c in STACK]))
    leaves = documents.select("fingerprint", F.explode(texts).alias("value")).where("value is not null")
    impure = pii.purity_check(leaves, ["fingerprint"], "value", patterns).groupBy("fingerprint").agg(F.min("first_pattern").alias("_pii"))
    fence = content_fence(F.to_json(F.struct("fitness", "stack_patterns", "common_gaps")))
    why = F.coalesce(F.concat(F.lit("pii "), "_pii"), F.concat(F.lit("fence "), fence.cast("string")))
    return documents.join(impure, "fingerprint", "left").withColumn("rejected", why).drop("_pii")
