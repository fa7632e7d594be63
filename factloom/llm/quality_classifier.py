"""Quality by compression: a text belongs to the class whose zstandard dictionary shortens it more.

One dictionary is built from good and one from bad labelled texts.  Each text is compressed chunk by chunk with both (a chunk is
short, so that the dictionary and not the text's own past decides); the difference of the two sizes over their sum, and the share
of the text that remains, become a score by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import stored
from factloom.llm.calibration import logistic_fit, sigmoid
from factloom.llm.sampling import labelled
from factloom.llm.textbatch import broadcast_fields, with_text_columns

SAMPLE_ROWS = 20_000
DICTIONARY_BYTES = 112 << 10
#: bytes of text per class that go into a dictionary: bounds what the driver holds
TRAIN_BYTES = 12 << 20
CHUNK_BYTES = 1024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray  # slopes for the features below and the intercept


def chunk_places(n: int, chunk: int) -> list[tuple[int, int]]:
    """Chunks of ``chunk`` bytes; a short rest joins the last one."""
    cuts = list(range(0, max(n - chunk // 2, 1), chunk))
    return list(zip(cuts, [*cuts[1:], n]))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[a:b] for t in texts for a, b in chunk_places(len(t), CHUNK_BYTES) if b > a]
    if sum(map(len, pieces)) < 10 * size or len(pieces) < 16:
        return b"".join(pieces)[-size:]  # too little to choose from: the texts are the dictionary
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def sizes_with(model_good: bytes, model_bad: bytes):
    """A function from (bytes, offsets) to rows of (bytes, size with the good, size with the bad dictionary)."""
    packs = []
    for content in (model_good, model_bad):
        entries = zstandard.ZstdCompressionDict(content) if content else None
        if entries:
            entries.precompute_compress(level=LEVEL)
        packs.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=entries, write_content_size=False, write_checksum=False, write_dict_id=False))

    def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        view, n = memoryview(data), np.diff(offsets)
        out = np.zeros((len(n), 3))
        for i in np.flatnonzero(n):
            start = int(offsets[i])
            out[i, 0] = n[i]
            for a, b in chunk_places(int(n[i]), CHUNK_BYTES):
                piece = view[start + a : start + b]
                out[i, 1] += len(packs[0].compress(piece))
                out[i, 2] += len(packs[1].compress(piece))
        return out

    return measure


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference (bad minus good over their sum), alone and with the share of the text that remains."""
    n, good, bad = sizes[:, 0], sizes[:, 1], sizes[:, 2]
    d = (bad - good) / np.maximum(bad + good, 1)
    left = np.where(n > 0, np.minimum(good, bad) / np.maximum(n, 1), 0.0)
    return np.column_stack((d, np.tanh(12 * d), np.minimum(left, 1.2), np.log1p(n) / 10))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, label: str = "quality", train_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from about ``rows`` labelled rows at most; equal texts count once.  Half of them (by a hash of the text) build the
    dictionaries, at most ``train_bytes`` per class, the other half fit the curve.  Without labels of both classes every text
    scores the base rate."""
    sample = stored(labelled(docs, labels, label, learn, rows).dropDuplicates(["text", "label"]).where("text <> ''"), "quality")
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2))
    dictionaries = {}
    for value in (1, 0):
        lengths = sample.where((half == 0) & (F.col("label") == value)).select(F.sum(F.octet_length("text"))).first()[0] or 0
        share = min(1.0, 0.9 * train_bytes / max(lengths, 1))
        taken, room = [], train_bytes
        chosen = sample.where((half == 0) & (F.col("label") == value) & (F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20))))
        for row in chosen.select("text").orderBy(F.xxhash64("text")).toLocalIterator():
            taken.append(row.text.encode())
            room -= len(taken[-1])
            if room < 0:
                break
        dictionaries[value] = _dictionary(taken, DICTIONARY_BYTES)
    good, bad = dictionaries[1], dictionaries[0]

    def start():
        measure = sizes_with(good, bad)
        return lambda data, offsets: list(measure(data, offsets).T)

    held = with_text_columns(sample.where(half == 1), "text", "n double, good double, bad double", start, ["label"]).toPandas()
    x, y = held[["n", "good", "bad"]].to_numpy(float).reshape(-1, 3), held["label"].to_numpy(int)
    return Model(good, bad, logistic_fit(features(x), y) if len(y) else np.array([0.0, 0.0, 0.0, 0.0, 0.0]))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with good_bytes, bad_bytes (compressed sizes), difference (normalised, -1 to 1), quality_score (0 to 1) and
    quality_predicted (1 from ``threshold`` on).

    Null and empty texts have sizes 0 and the score of difference 0.  Repeated rows score alike; nothing is shuffled.
    """
    load = broadcast_fields(df.sparkSession, model)

    def start():
        m = load()
        measure = sizes_with(m.good, m.bad)

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            sizes = measure(data, offsets)
            x = features(sizes)
            p = sigmoid(x @ m.curve[:-1] + m.curve[-1])
            return [sizes[:, 1].astype(np.int64), sizes[:, 2].astype(np.int64), x[:, 0], p, (p >= threshold).astype(np.int32)]

        return work

    return with_text_columns(df, text, "good_bytes long, bad_bytes long, difference double, quality_score double, quality_predicted int", start, keep)
