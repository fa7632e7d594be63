"""Concatenate and cut: documents become one long row of tokens, cut into sequences of fixed length.

The first pass tokenises once and notes each document's place among its partition's tokens.  Prefix sums over the partitions'
totals (one number per partition) give every document its place in the whole, and the second pass cuts at multiples of the length.
A sequence that spans two partitions gets pieces from both; such pieces are marked as boundary records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import stored
from factloom.llm.bpe import TokenIds, once_per_worker
from factloom.llm.textbatch import slices

LENGTH = 2048
END_ID = 1


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, place, n, ids): a document's ids and ``end_id``, little-endian unsigned (16 bits while the vocabulary allows,
    else 32), the partition it was in and its tokens' place there.  Written once, so that later passes do not tokenise again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = once_per_worker(TokenIds, tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                raw = data.tobytes()
                ids = [encoder.encode(raw[a:b].decode("utf-8", "replace")) + end for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // width
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part)), pa.array(places), pa.array(n), pa.array(np.full(len(n), width)), pa.array(ids, pa.binary())], ["doc_id", "part", "place", "n", "width", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(narrow.mapInArrow(run, "doc_id long, part long, place long, n long, width long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset,
    boundary and, if asked for, ids (little-endian unsigned 32-bit).

    Every id of every document (null or empty text: the end id alone) lies in exactly one piece; all sequences but the last are
    full, so only the last needs padding.  Repeated rows are packed once each.  An empty table gives no pieces.  The driver holds
    one number per input partition.
    """
    tokens = tokenized(docs, tokenizer, end_id)
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = sorted(totals)
    begins = dict(zip(parts, accumulate((totals[p] for p in parts), initial=0)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, place, n, width = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            first = np.array([begins[p] for p in part.tolist()], np.int64)
            begin = first + place
            windows = (begin + n - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(n)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = begin[row] // length + nth
            left, right = np.maximum(begin[row], sequence * length), np.minimum((begin + n)[row], (sequence + 1) * length)
            part_end = first + np.array([totals[p] for p in part.tolist()], np.int64)
            edge = (sequence * length < first[row]) | ((sequence + 1) * length > part_end[row])
            ids, pieces, i_before = batch.column(5), [], -1
            for i, a, b in zip(row.tolist(), (left - begin[row]).tolist(), (right - begin[row]).tolist()):
                if i != i_before:
                    values, i_before = np.frombuffer(ids[i].as_buffer(), "<u2" if width[i] == 2 else "<u4").astype("<u4"), i
                pieces.append(values[a:b].tobytes())
            crc = pa.array([zlib.crc32(p) for p in pieces], pa.int64())
            columns = [batch.column(0).take(pa.array(row)), pa.array(left - begin[row]), pa.array(right - left), crc, pa.array(n[row]), pa.array(sequence), pa.array(left - sequence * length), pa.array(edge)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names)

    return tokens.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): pieces with ids put together; a group holds ``length`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"))
