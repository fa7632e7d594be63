"""Language identification with error-correcting output codes.

Each language has a codeword; bit b of all codewords splits the languages in two, and one binary naive Bayes classifier over hashed
byte n-grams predicts it.  A text gets the language whose codeword has the least weighted logistic loss against all bit predictions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import stored
from factloom.llm.calibration import logistic_fit
from factloom.llm.sampling import bounded
from factloom.llm.textbatch import LETTER_BYTES, LOWER, broadcast_fields, byte_class, slices, with_text_columns

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 20_000
UNDETERMINED = "und"
_FOLD = np.where(LETTER_BYTES, LOWER, np.uint8(32))
_ASCII_LETTERS = byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SLICE = 1 << 18


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits: log odds of an n-gram
    scale: np.ndarray  # bits x 2: slope and intercept from mean log odds to the bit's log odds
    trust: np.ndarray  # bits: weight of a bit's loss


def codewords(n: int) -> np.ndarray:
    """All ways to split ``n`` languages in two (up to 7 languages), else 15 random balanced bits per doubling of ``n``."""
    if n <= 7:
        rows = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(rows, np.int8).T.reshape(n, -1)
    draw = np.random.Generator(np.random.PCG64(7))
    half = np.array([1, -1] * ((n + 1) // 2), np.int8)[:n]
    return np.stack([draw.permutation(half) for _ in range(15 * int(np.ceil(np.log2(n))))], axis=1)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of letters and single gaps, for each order in turn."""
    folded = _FOLD[data].astype(np.uint32)
    n = len(folded)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    buckets, texts = [], []
    for order in ORDERS:
        if n < order:
            continue
        value = np.zeros(n - order + 1, np.uint32)
        for k in range(order):
            value |= folded[k : n - order + 1 + k] << np.uint32(8 * k)
        # n-grams inside one text that do not start with a gap after a gap
        fine = (np.arange(n - order + 1) + order <= ends[: n - order + 1]) & ((value & np.uint32(0xFFFF)) != np.uint32(0x2020))
        buckets.append((((value[fine] ^ np.uint32(order * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64))
        texts.append(owner[: n - order + 1][fine])
    return (np.concatenate(buckets), np.concatenate(texts)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """texts x bits: mean log odds per n-gram, 0 for a text without n-grams."""
    texts = len(offsets) - 1
    total, n = np.zeros((texts, weights.shape[1])), np.zeros(texts)
    buckets, owner = ngram_buckets(data, offsets)
    cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    if len(cuts):
        np.add.at(total, owner[cuts], np.add.reduceat(weights[buckets], cuts, axis=0))
        n = np.bincount(owner, minlength=texts)
    return total / np.maximum(n, 1)[:, None]


def fit(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from about ``rows`` documents at most (a bounded sample by a hash of the id) for which ``learn`` holds and lang is not
    null.  The driver gets one count per language and bucket.  A table without such documents gives a model that knows no language."""
    known = docs.where(learn & F.col("lang").isNotNull())
    sample = stored(bounded(known, "doc_id", rows).select("text", "lang"), "langid")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 2)), np.zeros(0))
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(place) * BUCKETS, np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch, "text", SLICE):
                lang = np.array([place[x] for x in part.column(1).to_pylist()])
                buckets, owner = ngram_buckets(data, offsets)
                n += np.bincount(lang[owner] * BUCKETS + buckets, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    cells = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    counts = counts.reshape(len(languages), BUCKETS)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)  # each language counts alike
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log(one + 1e-7) - np.log(other + 1e-7)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text", SLICE):
                m = _margins(data, offsets, weights)
                yield pa.RecordBatch.from_arrays([pa.array([place[x] for x in part.column(1).to_pylist()], pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["lang", "m"])

    if not code.shape[1]:
        return Model(languages, code, weights, np.zeros((0, 2)), np.zeros(0))
    seen = sample.mapInArrow(margins, "lang int, m array<double>").toPandas()
    m, lang = np.stack(seen["m"].to_numpy()), seen["lang"].to_numpy()
    scale, trust = np.zeros((code.shape[1], 2)), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        truth = code[lang, b] > 0
        scale[b] = logistic_fit(m[:, b : b + 1], truth)
        error = np.clip(np.mean((m[:, b] * scale[b, 0] + scale[b, 1] > 0) != truth), 0.001, 0.499)
        trust[b] = np.log((1 - error) / error)
    return Model(languages, code, weights, scale, trust / trust.mean())


def identify(df: DataFrame, model: Model, text: str = "text", ambiguous_below: float = 0.2, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with lang_pred, score (0 to 1: the language's share among all), second_pred, margin (score minus the second's) and
    ambiguous (margin under ``ambiguous_below``).

    A text that is null, empty or without a letter, or a model without languages, gives ``und``, score 0, not ambiguous.  Equal
    losses go to the first language in order of name.
    """
    if not model.languages:
        return df.select(*(keep or df.columns)).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "second_pred": F.lit(None).cast("string"), "margin": F.lit(0.0), "ambiguous": F.lit(False)})
    load = broadcast_fields(df.sparkSession, model)

    def start():
        m = load()
        names = np.array(m.languages, object)

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            z = _margins(data, offsets, m.weights) * m.scale[:, 0] + m.scale[:, 1]
            loss = (m.trust * np.logaddexp(0, -z[:, None, :] * m.code[None])).sum(axis=2)
            odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
            p = odds / odds.sum(axis=1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")
            rows = np.arange(len(p))
            best, second = order[:, 0], order[:, min(1, p.shape[1] - 1)]
            ascii_letters = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[data])))
            lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                lettered[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            margin = p[rows, best] - np.where(second == best, 0, p[rows, second])
            return [
                np.where(lettered, names[best], UNDETERMINED), np.where(lettered, p[rows, best], 0.0), np.where(lettered & (second != best), names[second], None),
                np.where(lettered, margin, 0.0), lettered & (margin < ambiguous_below),
            ]

        return work

    return with_text_columns(df, text, "lang_pred string, score double, second_pred string, margin double, ambiguous boolean", start, keep, SLICE)
