"""Document fingerprints by a quartile bucket digest.

Every three bytes within five bytes in a row that hold the newest of them are hashed into one of 256 buckets.  A bucket's count is
coded by the quartile of the counts it lies in (two bits), so that the digest follows the profile of the text and not its size; the
length is coded on a logarithmic scale.  Two digests are compared by a difference that is bounded: from ``UNLIKE`` on they are as
different as digests can be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factloom.llm.sampling import bounded

BUCKETS = 256
REACH = 5
#: which two earlier bytes (counted back) go with the newest one
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: bytes hashed at once, so that a long text needs no multiple of its size
PIECE = 1 << 20
#: difference of codes that lie 0, 1, 2 and 3 quartiles apart
APART = np.array([0, 1, 2, 6])
LENGTH_STEPS, LENGTH_POINTS, LENGTH_MOST = 8, 2, 48
RATIO_POINTS, CHECK_POINTS = 4, 1
#: digests of unrelated texts of one alphabet differ by 1.1 to 1.7 points a bucket
UNLIKE = 1.4 * BUCKETS
HEADER = 5

#: a shuffle partition holds about so much text; more text than MOST_RANGES of them gives larger partitions
RANGE_BYTES, MOST_RANGES, SAMPLE = 8 << 20, 100_000, 20


def byte_tables(seed: int = 12) -> np.ndarray:
    """One table of 256 byte values for each place in a window: a permutation each, drawn from sha256."""
    rows = []
    for place in range(REACH):
        keys = [hashlib.sha256(f"{seed}:{place}:{value}".encode()).digest() for value in range(256)]
        rows.append(np.argsort(np.argsort(np.array([int.from_bytes(k[:8], "big") for k in keys], np.uint64))))
    return np.array(rows, np.uint8)


def bucket_counts(text: bytes, tables: np.ndarray) -> np.ndarray:
    """How many triplets of ``text`` fall into each bucket; triplets need at least three bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, len(data), PIECE):
        first = max(0, begin - REACH + 1)
        piece, lead = data[first : begin + PIECE], begin - first
        n = len(piece)
        at = [tables[place][piece] for place in range(REACH)]
        found = []
        for near, far in TRIPLETS:
            # the newest byte lies in this piece, so that no triplet is counted twice
            start = max(far, lead)
            if n > start:
                found.append(at[0][start:] ^ at[near][start - near : n - near] ^ at[far][start - far : n - far])
        if found:
            counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return counts


def digest(text: bytes, tables: np.ndarray) -> np.ndarray:
    """Header (length, check byte, ratios of the quartiles) and the code of every bucket, as small numbers."""
    counts = bucket_counts(text, tables)
    ordered = np.sort(counts)
    quarters = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quarters).sum(1)
    length = int(LENGTH_STEPS * np.log2(len(text) + 1))
    low, middle = ((quarters[:2] * 15) // max(int(quarters[2]), 1)).tolist()
    check = hashlib.sha256(text).digest()[0]
    return np.concatenate(([length >> 8, length & 255, check, low, middle], codes)).astype(np.int64)


def written(numbers: np.ndarray) -> str:
    """A digest as hex digits: the header, then four codes a byte."""
    codes = numbers[HEADER:].reshape(-1, 4) @ np.array([64, 16, 4, 1])
    return (bytes(numbers[:HEADER].tolist()) + bytes(codes.tolist())).hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).astype(np.int64)
    codes = (raw[HEADER:, None] >> np.array([6, 4, 2, 0])) & 3
    return np.concatenate((raw[:HEADER], codes.ravel()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 from a difference of ``UNLIKE`` on."""
    length = LENGTH_POINTS * abs(int(a[0] - b[0]) * 256 + int(a[1] - b[1]))
    ratios = RATIO_POINTS * int(np.abs(a[3:5] - b[3:5]).sum())
    points = min(length, LENGTH_MOST) + ratios + CHECK_POINTS * int(a[2] != b[2]) + int(APART[np.abs(a[HEADER:] - b[HEADER:])].sum())
    return max(0.0, 1.0 - points / UNLIKE)


def fingerprint_texts(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each whole text (null: empty); a column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    names, place = [f.name for f in kept], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_tables()
        for batch in batches:
            values = [written(digest((t or "").encode(), tables)) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(values, pa.string())], [*names, name])

    return df.mapInArrow(run, StructType([*kept, StructField(name, StringType())]))


# ---------------------------------------------------------------- each document and the next one


def _ranges(docs: DataFrame, key: str, text: str) -> list[float]:
    """Cuts between ranges of ids of about equal size, from a bounded sample of ids; they decide only where rows are handled."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wanted = min(MOST_RANGES, -(-int(size) // RANGE_BYTES)) or 1
    if wanted == 1:
        return []
    ids = sorted(float(r[0]) for r in bounded(docs.select(key).where(F.col(key).isNotNull()), key, wanted * SAMPLE).collect())
    return sorted({ids[len(ids) * i // wanted] for i in range(1, wanted)}) if ids else []


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, ahead) in sorted partitions, for a numeric key: every row is followed by its next row in descending ``key`` (nulls last, ties by
    text); rows with ``ahead`` end a partition and repeat the first row of the next one (after the last: of the first).

    Ranges of ids are partitions of their own.  Each text moves once; only the first row of a range is sent to a second place.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    cuts = _ranges(rows, "key", "text")
    splits = [-float("inf"), *cuts, float("inf")]
    numbered = rows.withColumn("_place", F.coalesce(F.col("key").cast("double"), F.lit(-float("inf"))))
    if len(splits) > 2:
        numbered = Bucketizer(splits=splits, inputCol="_place", outputCol="_range").transform(numbered).drop("_place")
    else:
        numbered = numbered.select("key", "text", F.lit(0.0).alias("_range"))
    numbered = numbered.withColumn("_range", F.col("_range").cast("int"))
    # at most MOST_RANGES rows: the first id of each range that has rows, and the range before it in the order
    heads = sorted(((r._range, r.head) for r in numbered.groupBy("_range").agg(F.max("key").alias("head")).collect()), reverse=True)
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    key_type = rows.schema["key"].dataType.simpleString()
    first = docs.sparkSession.createDataFrame(before, f"_head {key_type}, _to int")
    met = numbered.join(F.broadcast(first), F.col("key").eqNullSafe(F.col("_head")), "left")
    places = F.array_compact(F.array(
        F.struct(F.col("_range").alias("to"), F.lit(False).alias("ahead")),
        F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("to"), F.lit(True).alias("ahead"))),
    ))
    sent = met.select("key", "text", F.explode(places).alias("p")).select("key", "text", "p.to", "p.ahead")
    return sent.repartitionById(len(splits) - 1, "to").sortWithinPartitions("ahead", F.desc_nulls_last("key"), "text").select("key", "text", "ahead")


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last third of code points (rounded down) replaced by the first as many, or all, of the next
    document's, in descending ``key``; after the last comes the first, so a single document is its own next one.  Null texts are
    empty; an empty text is as like another empty one as can be (1).  Rows with one key are ordered by their text, null keys come
    last; repeated rows are rows like others.  Other columns are not read; an empty table gives no rows.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {COLUMNS}"
    names = [key, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_tables()
        # the row whose next one has not come yet, with its digest
        held: tuple | None = None
        done = False
        for batch in batches:
            out: list[Sequence] = []
            for at, (value, ahead) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                if done:
                    break
                own = value.as_py()
                made = digest(own.encode(), tables)
                if held is not None:
                    before, text_before, digest_before = held
                    n = len(text_before)
                    edited = (text_before[: n - n // 3] + own[: n // 3]).encode()
                    changed = digest(edited, tables)
                    out.append((before, n, hashlib.sha256(edited).hexdigest(), written(digest_before), written(changed), likeness(digest_before, changed), likeness(digest_before, made)))
                # of several rows with the id that comes next, the first ends the partition
                done = ahead
                held = (batch.column(0)[at].as_py(), own, made)
            if out:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return with_next(docs, key, text).mapInArrow(run, schema)
