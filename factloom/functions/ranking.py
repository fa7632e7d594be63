"""Ordering inside groups that may hold a large share of all rows.

A plain ``row_number() over (partition by g order by o)`` sorts a whole group in one task.  The helpers
here cut every group into ordered buckets first, rank inside a bucket, and add the totals of the earlier
buckets.  They are exact as long as the bucket expression is monotone in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key.  An aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Top k rows per group with their rank, all rows with ``k`` None.  ``row_number() <= k`` lets Spark drop the rest of each
    group before the shuffle (window group limit)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per key in ``order``.

    ``bucket`` must not decrease along ``order``.  One key may hold most rows: work is spread over
    (key, bucket), and only one row per (key, bucket) meets in a per-key window.
    """
    staged = df.withColumn("_bucket", bucket)
    for name, expr in sums.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    per_bucket = staged.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in sums],
    )


def ordinal(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based position per key in ``order`` by :func:`running_sums`."""
    return running_sums(df, keys, bucket, order, {name: F.lit(1).cast("long")})
