"""Toxic passages as maximum-scoring segments.

Tokens are words with their first letters as back-off features.  A token's score is the lower bound of its log odds between toxic
and other labelled texts under an informative Dirichlet prior, less a fixed cost, so that runs of usual words score below zero.
One linear scan finds all maximal segments of positive score.  Segment scores of harmless texts follow an extreme-value law; its
two parameters turn a segment's score into the expected number of such segments by chance (E), and a logistic fit turns the
evidence of all significant segments into the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import discard, stored
from factloom.llm.calibration import logistic_fit, sigmoid
from factloom.llm.sampling import labelled
from factloom.llm.textbatch import LETTER_BYTES, LOWER, broadcast_fields, slices, span_hashes, spans, with_text_columns

BUCKETS = 1 << 19
HEADS = (4, 5)
SAMPLE_ROWS = 40_000
#: text that is counted at a time; the arrays of a slice take some fifty times as much
COUNTED_BYTES = 1 << 18
PRIOR = 1000.0
SURE = 3.0
COST = 1.0
FIELDS = "tox_score double, tox_predicted int, evidence double, n_segments int, segments array<struct<start:int,end:int,score:double,e_value:double>>"


@dataclass(frozen=True)
class Model:
    token_scores: np.ndarray  # by bucket, before the cost
    rate: float  # lambda of the extreme-value law
    size: float  # K of the extreme-value law
    curve: np.ndarray  # slopes (sum, largest) and intercept of the calibration


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features x tokens buckets, starts, ends, tokens per text); tokens are runs of letters in lower case."""
    folded = LOWER[data]
    mask, starts, ends, counts = spans(folded, offsets, LETTER_BYTES)
    hashes = span_hashes(folded, mask, starts, ends, seed=3, heads=HEADS)
    return np.stack([(h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in hashes]), starts, ends, counts


def best_scores(buckets: np.ndarray, token_scores: np.ndarray) -> np.ndarray:
    return token_scores[buckets].max(axis=0) - COST


def dirichlet_log_odds(toxic: np.ndarray, clean: np.ndarray, totals: tuple[float, float], prior: float = PRIOR, sure: float = SURE) -> np.ndarray:
    """The part of each bucket's log odds that ``sure`` standard deviations leave over; the prior is the pooled distribution.
    ``totals`` are the sums of all buckets by class, of which the arrays may be a part; a bucket of no text has 0."""
    pooled = toxic + clean
    alpha = prior * (pooled + 1e-3) / (totals[0] + totals[1] + 1e-3 * BUCKETS)
    a, b = toxic + alpha, clean + alpha
    delta = np.log(a / np.maximum(totals[0] + prior - a, 1e-9)) - np.log(b / np.maximum(totals[1] + prior - b, 1e-9))
    spread = sure * np.sqrt(1 / a + 1 / b)
    return np.sign(delta) * np.maximum(np.abs(delta) - spread, 0)


def maximal_segments(scores: np.ndarray, places: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa), amortised linear.  ``places`` are the tokens with a positive score and
    ``before`` the running sum in front of each; tokens between them only lower the running sum."""
    found: list[list] = []  # start, end, sum before, sum after
    for i, left in zip(places.tolist(), before.tolist()):
        new = [i, i + 1, left, left + float(scores[i])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def scan(scores: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """Segments of each text, token places counted in the slice."""
    out: list[list] = [[] for _ in counts]
    total = np.cumsum(scores) if len(scores) else np.zeros(0)
    positive = np.flatnonzero(scores > 0)
    ends = np.cumsum(counts)
    cut = np.searchsorted(positive, np.concatenate(([0], ends)))
    for t in np.flatnonzero(np.diff(cut)):
        at = positive[cut[t] : cut[t + 1]]
        out[t] = maximal_segments(scores, at, total[at] - scores[at])
    return out


def chance_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * score)) = 1, by bisection; 1.0 where scores have no positive value or the mean is
    not negative."""
    p = weights / max(weights.sum(), 1)
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda r: float((p * np.exp(np.minimum(r * values, 600))).sum()) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _document_evidence(found: list[float], tokens: int, rate: float, size: float) -> tuple[float, float]:
    """(sum, largest) of -log E over the significant segments, by their scores."""
    base = np.log(max(size * max(tokens, 1), 1e-12))
    parts = [rate * s - base for s in found if rate * s > base]
    return float(sum(parts)), float(max(parts, default=0.0))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, label: str = "toxic") -> Model:
    """Learn from about ``rows`` labelled rows at most (a bounded sample by a hash of the id); equal texts count once.  The driver
    gets the buckets whose score is not 0 and a few numbers per sampled row.  No labels of one class: every text scores the base rate."""
    sample = stored(labelled(docs, labels, label, learn, rows).dropDuplicates(["text", "label"]), "toxicity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch, "text", COUNTED_BYTES):
                buckets, _, _, counts = token_buckets(data, offsets)
                owner = np.repeat(np.arange(len(counts)), counts)
                cells = np.unique((owner * BUCKETS + buckets).ravel())  # a text counts once for a bucket
                np.add.at(n, part.column(1).to_numpy(zero_copy_only=False)[cells // BUCKETS] * BUCKETS + cells % BUCKETS, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    by_class = [F.sum(F.when(F.col("cell") >= BUCKETS if side else F.col("cell") < BUCKETS, F.col("n")).otherwise(0)).alias(c) for c, side in (("toxic", 1), ("clean", 0))]
    counted = stored(sample.mapInArrow(count, "cell long, n long").groupBy((F.col("cell") % BUCKETS).alias("bucket")).agg(*by_class), "toxicity-counts")
    totals = tuple(float(n or 0) for n in counted.agg(F.sum("toxic"), F.sum("clean")).first())

    def sure_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = (batch.column(i).to_numpy().astype(float) for i in (1, 2))
            scores = dirichlet_log_odds(toxic, clean, totals).astype(np.float32)
            at = np.flatnonzero(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(scores[at])], ["bucket", "score"])

    found = counted.mapInArrow(sure_ones, "bucket long, score float").toPandas()
    discard(counted)
    token_scores = np.zeros(BUCKETS, np.float32)
    token_scores[found["bucket"].to_numpy(np.int64)] = found["score"].to_numpy(np.float32)
    grid = np.arange(-120, 241) / 8.0 - COST
    shared = sample.sparkSession.sparkContext.broadcast(token_scores)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                buckets, _, _, n = token_buckets(data, offsets)
                scores = best_scores(buckets, shared.value)
                found = scan(scores, n)
                owner = np.repeat(np.arange(len(n)), n)
                step = np.clip(np.rint((scores + COST) * 8) + 120, 0, len(grid) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(n.astype(np.int64)), pa.array([[s for _, _, s in x] for x in found], pa.list_(pa.float64())),
                     pa.array([np.bincount(step[owner == t]).tolist() if not y else None for t, y in enumerate(part.column(1).to_pylist())], pa.list_(pa.int64()))],
                    ["label", "n", "s", "steps"])

    seen = sample.mapInArrow(segments, "label int, n long, s array<double>, steps array<long>")
    spread = np.zeros(len(grid))
    for row in seen.select(F.posexplode("steps").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        spread[row["at"]] = row["n"]
    rate = chance_rate(grid, spread)
    docs_seen = seen.select("label", "n", "s").toPandas()
    y = docs_seen["label"].to_numpy(int)
    if not len(y):
        return Model(token_scores, 1.0, 1.0, np.array([0.0, 0.0, -10.0]))
    tops = np.array([max(s, default=0.0) for s in docs_seen["s"]])
    n = docs_seen["n"].to_numpy(float)
    clean = (y == 0) & (n > 0)
    # K n exp(-rate S) is exponential with mean 1 over the best segments of harmless texts
    size = 1.0 / max(float(np.mean(n[clean] * np.exp(-rate * tops[clean]))), 1e-9) if clean.any() else 1.0
    evidence = np.array([_document_evidence(s, int(k), rate, size) for s, k in zip(docs_seen["s"], n)])
    return Model(token_scores, rate, size, logistic_fit(np.log1p(evidence), y))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with tox_score (0 to 1), tox_predicted (1 from ``threshold`` on), evidence, n_segments and the significant segments
    (byte places in the UTF-8 text, segment score, expected number by chance under 1).

    Null, empty and letterless texts have no segment and score what such texts score.  Repeated rows score alike; nothing is shuffled.
    """
    load = broadcast_fields(df.sparkSession, model)

    def start():
        m = load()

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            buckets, starts, ends, n = token_buckets(data, offsets)
            found = scan(best_scores(buckets, m.token_scores), n)
            owner_start = offsets[:-1]
            evidence, listed = np.zeros((len(n), 2)), []
            for t, x in enumerate(found):
                evidence[t] = _document_evidence([s for _, _, s in x], int(n[t]), m.rate, m.size)
                rows = []
                for a, b, s in x:
                    e = float(np.exp(np.clip(np.log(max(m.size * n[t], 1e-12)) - m.rate * s, -700, 700)))
                    if e < 1:
                        rows.append({"start": int(starts[a] - owner_start[t]), "end": int(ends[b - 1] - owner_start[t]), "score": s, "e_value": e})
                listed.append(rows)
            p = sigmoid(np.log1p(evidence) @ m.curve[:-1] + m.curve[-1])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
            return [p, (p >= threshold).astype(np.int32), evidence[:, 0], np.array([len(r) for r in listed], np.int32), pa.array(listed, kind)]

        return work

    return with_text_columns(df, text, FIELDS, start, keep)


def keep_harmless(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they were."""
    model = fit(docs, labels, learn)
    # the text goes to Python and back once, the other columns in one struct beside it
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*[docs[f"`{c}`"] for c in others]).alias("row"))
    harmless = score(rows, model, threshold=threshold, keep=["text", "row"]).where("tox_predicted = 0")
    return harmless.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
