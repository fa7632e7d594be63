"""Lookups of a large table in a smaller one when a few keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import stored

#: rows of one key that one task may get
ROWS_PER_TASK = 200_000
#: hot keys that are broadcast; more of them meet the rows in a join on the key
MOST_HOT = 100_000
#: bins of key hashes that are counted to see whether any key can be hot
BINS = 1 << 16


def _counts(stream: DataFrame, key: Sequence[Column], rows_per_task: int) -> DataFrame:
    """(``key``, count) of the keys that may have more than ``rows_per_task`` rows: those whose bin has.  The bins are counted before any
    shuffle, and where none is that full, no key is counted."""
    binned = stream.select(*key, F.pmod(F.xxhash64(*key), F.lit(BINS)).alias("_bin"))
    full = stored(binned.groupBy("_bin").count().where(F.col("count") > rows_per_task).select("_bin"), "full-bins")
    return binned.join(F.broadcast(full), "_bin", "left_semi").groupBy(*key).count()


def lookup_join(stream: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", rows_per_task: int = ROWS_PER_TASK, most_hot: int = MOST_HOT,
                counts: DataFrame | None = None) -> DataFrame:
    """``stream`` joined with ``table`` on ``keys`` (``how``: left or inner): the same rows as a plain join, whatever the skew.

    Keys with more than ``rows_per_task`` rows in ``stream`` are found by a count of the bins of their hashes, then of the keys in full bins.  Their rows are dealt
    over count / rows_per_task salts by a hash of the whole row, and the rows of ``table`` are copied for the salts of these keys
    only.  There are at most rows / rows_per_task hot keys, one short row each.  ``stream`` is read up to three times, so it should be a
    stored table; ``counts`` (``keys``, count) saves the first reading where it is known.  Null keys meet nothing, as in any join; they are dealt out as well.  Equal rows stay together, so only rows that differ
    somewhere are spread.
    """
    key = [F.col(f"`{k}`") for k in keys]
    salts = F.ceil(F.col("count") / rows_per_task).cast("int").alias("_salts")
    counts = _counts(stream, key, rows_per_task) if counts is None else counts
    hot = stored(counts.where(F.col("count") > rows_per_task).select(*key, salts), "hot-keys")
    n = hot.count()
    if not n:
        return stream.join(table, list(keys), how)

    def marked(df: DataFrame) -> DataFrame:
        names = {k: f"_hot_{i}" for i, k in enumerate(keys)}
        side = hot.withColumnsRenamed(names)
        side = F.broadcast(side) if n <= most_hot else side
        same = [df[f"`{k}`"].eqNullSafe(side[names[k]]) for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return df.join(side, on, "left").drop(*names.values())

    row = F.xxhash64(*[F.col(f"`{c}`") for c in stream.columns])
    dealt = marked(stream).withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(row, F.col("_salts")).cast("int"))).drop("_salts")
    all_salts: Column = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = marked(table).withColumn("_salt", F.explode(all_salts)).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
