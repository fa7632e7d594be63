"""Bounded samples of labelled rows and folds of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: as the text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, by a hash of ``key``: the same rows for any partitioning.  The count reads
    the narrow columns only."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 30)) < share)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(text, label) of at most about ``rows`` labelled documents for which ``learn`` (a condition on doc_id) holds, equal
    pairs once.  The sampled labels are broadcast: their number is bounded by ``rows``, so no text is shuffled before."""
    wanted = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    chosen = bounded(wanted, "doc_id", rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "label")
