"""Quality rules: base counts of a text, and compression bands.

A text's zstandard ratio (compressed bytes / bytes) is low when it repeats itself and high when it is noise.  The usual ratio
depends on the length, so each length has its own band; fixed chunks are measured as well, because a long clean text can hide a
repetitive or random half.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textbatch import WORD_BYTES, byte_class, mix64, span_hashes, spans, sums_by_text, windows, with_text_columns

#: fixed values: symbols of the contract
SYMBOLS = byte_class(b"#*$%&|<>")
#: (bytes at least, lowest ratio, highest ratio) for whole texts; shorter texts than the first row have no band
BANDS = ((64, 0.40, 1.20), (256, 0.35, 0.95), (1024, 0.30, 0.75), (4096, 0.25, 0.65), (16384, 0.22, 0.60))
CHUNK_BYTES = 2048
CHUNK_BAND = (0.18, 0.72)
#: bad chunks that a text may have; of the 1,338 texts of sf0.1 labelled good that pass the other rules, none has a bad chunk
CHUNK_SHARE = 0.05
COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, "
    "n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean"
)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text; equal words, lines and windows are equal
    64-bit hashes."""
    mask, starts, ends, counts = spans(data, offsets, WORD_BYTES)
    text_bytes = np.diff(offsets)
    word_chars = sums_by_text((mask & ((data & 0xC0) != 0x80)).astype(np.int64), text_bytes)
    symbols = sums_by_text(SYMBOLS[data].astype(np.int64), text_bytes)
    [hashes] = span_hashes(data, mask, starts, ends)

    line_mask, line_starts, line_ends, line_counts = spans(data, offsets, ~byte_class(b"\n"))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    text_of_line = np.repeat(np.arange(len(line_counts)), line_counts)
    [line_hashes] = span_hashes(data, line_mask, line_starts, line_ends, seed=2)
    lines, owners = line_hashes[worded], text_of_line[worded]
    _, first = np.unique(mix64(lines + owners.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)
    n = len(counts)
    dup_lines = np.bincount(owners, minlength=n) - np.bincount(owners[first], minlength=n)

    keys, at = windows(hashes, counts, 5)
    text_of_word = np.repeat(np.arange(n), counts)
    _, group, size = np.unique(mix64(keys + text_of_word[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_inverse=True, return_counts=True)
    twice = at[size[group] > 1]
    change = np.bincount(twice, minlength=len(hashes) + 6) - np.bincount(twice + 5, minlength=len(hashes) + 6)
    covered = np.cumsum(change)[: len(hashes)] > 0
    return counts, word_chars, symbols, dup_lines, sums_by_text(covered.astype(np.int64), counts)


def compression_bands(df: DataFrame, text: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS, chunk_bytes: int = CHUNK_BYTES,
                      chunk_band: tuple[float, float] = CHUNK_BAND, chunk_share: float = CHUNK_SHARE, level: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` and for each text the base counts, its ratio, the number of chunks outside ``chunk_band``, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rule fails, where the ratio lies outside the band of the text's length, or where more than
    ``chunk_share`` of its chunks lie outside theirs; the last chunk is the end of the text and may overlap the one before.  Null and empty texts have no words, ratio 0 and fail the base rule.
    Repeated rows are judged alike; nothing is shuffled.
    """
    sizes = [b[0] for b in bands]
    low, high = [0.0, *(b[1] for b in bands)], [np.inf, *(b[2] for b in bands)]

    def start():
        compressor = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            n_words, word_chars, symbols, dup_lines, repeats = base_counts(data, offsets)
            view, n = memoryview(data), np.diff(offsets)
            ratio, chunks, bad = np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i in np.flatnonzero(n):
                a, b = int(offsets[i]), int(offsets[i + 1])
                ratio[i] = len(compressor.compress(view[a:b])) / (b - a)
                # the rest after the last full chunk is measured as the final chunk_bytes of the text
                begins = [*range(a, b - chunk_bytes + 1, chunk_bytes)]
                if begins and (b - a) % chunk_bytes:
                    begins.append(b - chunk_bytes)
                chunks[i] = len(begins)
                for k in begins:
                    r = len(compressor.compress(view[k : k + chunk_bytes])) / chunk_bytes
                    bad[i] += not chunk_band[0] <= r <= chunk_band[1]
            band = np.searchsorted(sizes, n, "right")
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            outside = (ratio < np.take(low, band)) | (ratio > np.take(high, band)) | (bad > chunk_share * chunks)
            return [*(c.astype(np.int64) for c in (n_words, word_chars, symbols, dup_lines, repeats, n)), ratio, chunks, bad, failed, ~failed & ~outside]

        return work

    return with_text_columns(df, text, COLUMNS, start, keep)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows whose text passes, with their columns as they were."""
    judged = compression_bands(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")), keep=["row"], **limits)
    return judged.where("kept").select("row.*")
