"""Source divergence against a plain recomputation, and odd input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "text string, lang string, source string, n long, value long, doc_id long"


def brute(rows, min_docs, top):
    docs = [(t or "", lang or "", s or "") for t, lang, s, *_ in rows]
    df, group, langs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, s in docs:
        words = [w.translate(UPPER) for w in TERM.findall(t)]
        df[lang].update(set(words))
        group[lang, s].update(words)
        langs[lang].update(words)
        groups[lang].add(s)
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, k in df[lang].items() if k >= min_docs]

        def shares(counts):
            whole = sum(counts[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // whole for w in kept}

        q, p = shares(langs[lang]), {s: shares(group[lang, s]) for s in sources}
        far = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in sources:
            pairs = [(-sum(far(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-far(p[s][w], q[w]), w.encode(), w) for w in kept if group[lang, s][w] and p[s][w] > q[w]]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    words = ["alpha", "Beta", "GAMMA", "délta", "Éta", "日本", "x", "don't", "a1b", "😀", "end.", "zeta-eta"]
    out = []
    for i in range(150):
        lang = ["en", "fr", None, "e n"][int(draw.integers(4))]
        source = ["s0", "s0", "s1", "s2", None, "ß"][int(draw.integers(6))]
        weights = draw.dirichlet(np.ones(len(words)) * (0.3 if source == "s1" else 2))
        out.append((" ".join(draw.choice(words, int(draw.integers(0, 30)), p=weights)), lang, source, i, 1, i))
    out += [(None, "en", "s9", 1, 1, 200), ("", "xx", "only", 1, 1, 201), ("123 ...", "xx", "other", 1, 1, 202), ("Rare word", "one", "s", 1, 1, 203)]
    return out + out[:7]


@pytest.mark.parametrize("min_docs,top", [(10, 10), (1, 3), (1000, 10)])
def test_divergence_equals_brute_force(spark, rows, min_docs, top):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = divergence.source_divergence(df, min_docs, top).collect()
    assert {tuple(r) for r in got} == brute(rows, min_docs, top)
    assert len(got) == len({tuple(r) for r in got})


def test_slices_and_order_of_rows_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    got = divergence.source_divergence(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1), 10, None)
    assert {tuple(r) for r in got.collect()} == brute(rows, 10, 10**6)


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = divergence.source_divergence(none)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0
    long = " ".join(f"w{chr(97 + k % 26)}" for k in range(1_000_000))
    rows = [(long, "en", "a", 1, 1, 1)] + [("wa wb", "en", "b", 1, 1, i) for i in range(2, 14)]
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), 10, 10)
    assert {tuple(r) for r in got.collect()} == brute(rows, 10, 10)


def test_share_is_exact(spark):
    cases = [(2, 3), (2, 7), (10**15, 10**15 + 1), (8 * 10**15, 9 * 10**15 - 7), (5, 5)]
    got = spark.createDataFrame(cases, "c long, t long").select(divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * c // t for c, t in cases]
