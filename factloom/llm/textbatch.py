"""Whole texts as byte arrays inside a task: Arrow batches are cut into slices of bounded size and handled with numpy.

A slice holds whole texts, so memory follows the longest text, never the partition.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection), so that linear sums of bytes become even hashes."""
    x = values.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit factors, one per place in a word."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)) | np.uint64(1)


def byte_class(members: bytes | Sequence[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: fixed values: the separators of words in the contracts, [\x20\x09-\x0D]
WORD_BYTES = ~byte_class(b" \t\n\x0b\x0c\r")
#: letters for word features: ASCII letters and every byte of a longer code point
LETTER_BYTES = byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets count from 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for consecutive rows of at most ``most`` bytes of text, one row at least."""
    data, offsets = text_arrays(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class that do not cross texts: (mask, starts, ends, runs per text)."""
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], mask[:-1])) if len(mask) else mask
    after = np.concatenate((mask[1:], [False])) if len(mask) else mask
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return mask, starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, heads: Sequence[int] = ()) -> list[np.ndarray]:
    """64-bit hashes of the runs, then for each of ``heads`` of the run's first bytes."""
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (1 + len(heads))
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    products = (data[mask].astype(np.uint64) + np.uint64(1)) * multipliers(int(lengths.max()), seed)[place]
    out = [mix64(np.add.reduceat(products, first))]
    for n in heads:
        out.append(mix64(np.add.reduceat(np.where(place < n, products, np.uint64(0)), first) + np.uint64(n)))
    return out


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row and the place of the first; windows do not cross texts."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(total) + n <= last)
    factor = multipliers(n, 77)
    sums = np.zeros(len(at), np.uint64)
    for k in range(n):
        sums += hashes[at + k] * factor[k]
    return mix64(sums), at


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, 0 for an empty one."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def with_text_columns(df: DataFrame, text: str, added: str | StructType, start: Callable, keep: Sequence[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """``df``'s columns (or those in ``keep``) and the columns that ``start()(bytes, offsets)`` gives for each text.

    ``start`` runs once a task and loads what the work needs.  A column of ``df`` that has the name of an added one is replaced.
    """
    added = StructType.fromDDL(added) if isinstance(added, str) else added
    new = {name.lower() for name in added.names}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for rows, data, offsets in slices(batch, text, most):
                work = work or start()
                columns = work(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(n) for n in names] + [pa.array(c) for c in columns], names + added.names)

    read = list(dict.fromkeys([*names, text]))
    return df.select(*[f"`{c}`" for c in read]).mapInArrow(run, StructType([*kept, *added.fields]))


def broadcast_fields(spark: SparkSession, model: object) -> Callable[[], SimpleNamespace]:
    """Broadcast a model of bounded size as plain values: workers need no class of this package to read it."""
    shared = spark.sparkContext.broadcast(dict(vars(model)))
    return lambda: SimpleNamespace(**shared.value)
