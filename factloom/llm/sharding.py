"""A reproducible shuffle into shards by a keyed permutation of global row numbers.

Rows get numbers 0 to N-1 in the order of (doc_id, text checksum, size).  An alternating Feistel network over a x b >= N cells, with
cycle walking for the few cells from N on, permutes the numbers; the permuted number gives shard and slot.  Both directions are plain
SQL expressions, so a row's shard and slot, and the row of a shard's slot, are computable from N and the key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.checkpoints import stored

ROUNDS = 8
#: longest walk: N cells and fewer than sqrt(N) + 1 beyond them, so a walk of 64 steps has a chance of about N ** -31 for large N
WALK = 64


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _network(value: str, n: int, key: int, back: bool) -> str:
    a, b = _sides(n)
    order, sign = (f"sequence({ROUNDS}, 1, -1)", "-") if back else (f"sequence(1, {ROUNDS})", "+")
    left = f"named_struct('l', pmod(s.l {sign} pmod(xxhash64(s.r, j, {key}L), {a}L), {a}L), 'r', s.r)"
    right = f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod(xxhash64(s.l, j, {key}L), {b}L), {b}L))"
    return f"aggregate({order}, named_struct('l', {value} % {a}L, 'r', {value} div {a}L), (s, j) -> if(j % 2 = 1, {left}, {right}), s -> s.l + {a}L * s.r)"


def permuted(column: str, n: int, key: int, back: bool = False) -> str:
    """SQL for the place of row number ``column`` (a long below ``n``), or with ``back`` the row number of a place."""
    a, b = _sides(n)
    steps = min(max(a * b - n, 1), WALK)
    column = f"({column})"
    walked = f"aggregate(sequence(1, {steps}), {_network(column, n, key, back)}, (y, k) -> if(y < {n}L, y, {_network('y', n, key, back)}))"
    return f"(transform(array({walked}), y -> if(y < {n}L, y, raise_error('cycle walk too long: choose another key')))[0])"


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with a global ``row_number`` from 0 in the order of ``order``, and their number.  Equal rows may change places: that
    changes nothing.  Ranges are cut with a salt, so that many rows with one key are split as well; no window spans all rows, only
    one count per partition is summed in order."""
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    placed = stored(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # one row per partition of the sort: bounded by the number of tasks
    return placed.join(F.broadcast(starts), "part").withColumn("row_number", F.col("first") + F.col("place")).drop("part", "place", "first"), total


def shard_rows(docs: DataFrame, shards: int = 16, key: int = 20_240_601) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and 1; null text: 1), text_crc32, row_number, shard, slot.

    Counts of shards differ by one at most and slots are gapless from 0.  Rows with equal ids or texts are rows of their own; null
    ids come first.  Texts are reduced to size and checksum before anything is shuffled.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered(narrow, "doc_id", "text_crc32", "size")
    place = rows.withColumn("place", F.expr(permuted("row_number", max(total, 1), key)))
    return place.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")}).drop("place")
