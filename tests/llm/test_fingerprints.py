"""Quartile bucket digests against a plain recomputation, and odd input."""

import hashlib
import math

import numpy as np
import pytest

from factloom.llm import fingerprints

SCHEMA = "doc_id long, text string, fingerprint string, n_chars string, near_next long"
TABLES = fingerprints.byte_tables()


def plain_digest(text):
    """(header, codes) by single bytes."""
    t, counts = TABLES.tolist(), [0] * 256
    for i in range(len(text)):
        for near, far in ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)):
            if i >= far:
                counts[t[0][text[i]] ^ t[near][text[i - near]] ^ t[far][text[i - far]]] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    size = int(8 * math.log2(len(text) + 1))
    header = [size >> 8, size & 255, hashlib.sha256(text).digest()[0], q[0] * 15 // max(q[2], 1), q[1] * 15 // max(q[2], 1)]
    return header, [sum(c > x for x in q) for c in counts]


def plain_text(header, codes):
    return bytes(header + [codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 256, 4)]).hex()


def plain_likeness(a, b):
    (x, p), (y, q) = a, b
    points = min(48, 2 * abs(x[0] * 256 + x[1] - y[0] * 256 - y[1])) + 4 * (abs(x[3] - y[3]) + abs(x[4] - y[4])) + (x[2] != y[2])
    return max(0.0, 1 - (points + sum((0, 1, 2, 6)[abs(i - j)] for i, j in zip(p, q))) / (1.4 * 256))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (k, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        a, b, c = (plain_digest(x.encode()) for x in (t, edited, after))
        out.append((k, n, hashlib.sha256(edited.encode()).hexdigest(), plain_text(*a), plain_text(*b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    words = ["alpha", "beta", "Gamma", "délta", "日本語", "😀", "\n", "zeta."]
    made = [(int(i), " ".join(draw.choice(words, int(draw.integers(0, 60)))), "x", "y", 1) for i in draw.permutation(90) * 37 - 500]
    odd = ["", None, "a", "ab", "abc", "abcd", "é", "aaaaaaaaaaaa"]
    made += [(10_000 + i, t, None, None, None) for i, t in enumerate(odd)] + [(None, "without id", "x", "y", 1), (None, None, "x", "y", 1)]
    made += [(2**60 + 1, "far away", "x", "y", 1), (2**60, "far off", "x", "y", 1), (5000, made[0][1], "x", "y", 1), (5000, "other text of one id", "x", "y", 1)]
    return made + made[:4]


@pytest.mark.parametrize("range_bytes", [100, 700, 1 << 20])
def test_results_equal_brute_force(spark, rows, monkeypatch, range_bytes):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    got = fingerprints.compare_with_next(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got, want = sorted((tuple(r) for r in got.collect()), key=repr), brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want])


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    text = ("the quick brown fox é " * 500).encode()
    whole = fingerprints.bucket_counts(text, TABLES)
    monkeypatch.setattr(fingerprints, "PIECE", 97)
    assert (fingerprints.bucket_counts(text, TABLES) == whole).all()
    assert whole.sum() == sum(len(text) - far for _, far in fingerprints.TRIPLETS)


def test_text_form_is_read_back_and_likeness_is_bounded():
    digests = [fingerprints.digest(t, TABLES) for t in (b"", b"a", b"abcabc" * 90, b"xyz" * 4000, bytes(range(256)) * 9)]
    for a in digests:
        assert (fingerprints.read(fingerprints.written(a)) == a).all()
        assert fingerprints.likeness(a, a) == 1
        for b in digests:
            assert fingerprints.likeness(a, b) == fingerprints.likeness(b, a) and 0 <= fingerprints.likeness(a, b) <= 1


def test_single_and_no_rows_and_extra_columns(spark, rows):
    one = fingerprints.compare_with_next(spark.createDataFrame([(7, "one text only", "x", "y", 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprints.compare_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame(rows, SCHEMA)
    out = fingerprints.fingerprint_texts(df)
    assert sorted(out.columns) == sorted(df.columns)
    by_text = {}
    for r in out.collect():
        assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint == plain_text(*plain_digest((r.text or "").encode()))


def test_edited_texts_are_nearer_than_other_texts(spark, sf):
    got = fingerprints.compare_with_next(spark.read.parquet(f"{sf}/documents.parquet")).where("n_chars >= 50").toPandas()
    other = got[got.near_next < 1]
    assert (other.near_edited > other.near_next).mean() > 0.98
