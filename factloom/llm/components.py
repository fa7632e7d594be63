"""Connected components by alternating stars: one row per link, never a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import discard, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link in ``links`` (a, b); a component is named by its least node.

    Each round replaces links by links to the least neighbour; rounds grow with the logarithm of the longest path.  No link is lost;
    an error is raised if ``rounds`` do not suffice.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "links")
    state = None
    for _ in range(rounds):
        before, pairs = pairs, stored(_small_star(_large_star(pairs).distinct()).distinct(), "links")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
