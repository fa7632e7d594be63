"""Restricting fact tables to parts of a repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INLINE_PREFIXES = 1000


def under(path: Column, prefixes: Sequence[str]) -> Column:
    """Path starts with one of the prefixes; no prefixes means everything."""
    if not prefixes:
        return F.lit(True)
    if len(prefixes) > MAX_INLINE_PREFIXES:
        raise ValueError("use slice_by_prefix_table for many prefixes")
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(path, p))


def slice_rows(facts: DataFrame, prefixes: Sequence[str], column: str = "path") -> DataFrame:
    return facts.filter(under(F.col(column), prefixes))


def slice_edges(edges: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Edges that touch the slice with either end."""
    return edges.filter(under(F.col("src"), prefixes) | under(F.col("dst"), prefixes))


def slice_cycles(cycles: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """All members of components with a member in the slice."""
    hit = cycles.filter(under(F.col("path"), prefixes)).select("repo_id", "component").distinct()
    return cycles.join(hit, ["repo_id", "component"], "left_semi")


def slice_by_prefix_table(facts: DataFrame, prefixes: DataFrame, column: str = "path") -> DataFrame:
    """Many prefixes per repository: (repo_id, slice, prefix) rows.

    The prefix condition becomes an equi-join: a path is cut at every length that occurs among the repository's
    prefixes.  The lengths are one small row per repository; a path belongs to a slice once.
    """
    lengths = prefixes.groupBy("repo_id").agg(F.collect_set(F.length("prefix")).alias("_lens"))
    cut = facts.join(lengths, "repo_id").withColumn("_len", F.explode("_lens")).filter(F.col("_len") <= F.length(column))
    keyed = cut.withColumn("prefix", F.left(F.col(column), F.col("_len"))).drop("_lens", "_len")
    return keyed.join(prefixes.distinct(), ["repo_id", "prefix"]).drop("prefix").distinct()
