"""The short way of the word tokenizer, what the fit of toxicity brings to the driver, and the bound before lines are compared."""

from types import SimpleNamespace

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import line_dedup, toxicity
from factloom.llm.bpe import TokenIds


def test_letters_alone_need_no_pattern():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ids = Tokenizer.from_file(path), TokenIds(path)
    pattern, asked = ids.pattern, []
    ids.pattern = SimpleNamespace(findall=lambda s: asked.append(s) or pattern.findall(s))
    odd = ["don't", "it's,", "a1b", "2024", "x_y", "\"'s", "..", "o'clock", "3rd."]
    plain = "The QUICK brown, fox. Élan × ŉ Straße; end' a7 (x)\n\tb! ' . 5 ÷2"
    for text in ["", " ", plain, " ".join(odd), *odd, "日本 two words", "a<|endoftext|>b", "ctrl\x01x"]:
        assert np.frombuffer(ids.encode(text), ids.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not {"the", "quick", "brown,", "fox.", "élan", "straße;", "end'", "a7", "b!"} & set(asked)


def test_the_fit_brings_only_sure_buckets(spark, monkeypatch):
    rows = [(i, f"word{i} plain talk" + (" vile filth" if i % 2 else " kind praise")) for i in range(200)] + [(200, ""), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    brought, kind = [], type(docs)
    to_pandas = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda df: brought.append(to_pandas(df)) or brought[-1])
    model = toxicity.fit(docs, labels, F.lit(True))
    counts = np.zeros((2, toxicity.BUCKETS))
    for i, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        counts[i % 2, np.unique(toxicity.token_buckets(data, np.array([0, len(data)]))[0])] += 1
    want = toxicity.dirichlet_log_odds(counts[1], counts[0], (counts[1].sum(), counts[0].sum())).astype(np.float32)
    assert (model.token_scores == want).all()
    assert 0 < len(brought[0]) == np.count_nonzero(want) < np.count_nonzero(counts.sum(axis=0)) and all(len(b) <= len(rows) for b in brought)


def test_character_counts_bound_the_edits(spark):
    rng = np.random.default_rng(5)
    letters = list("aabcdez  é日😀.")
    lines = ["", "a", *("".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(40))]
    lines = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.expr(line_dedup.character_counts("line")).alias("counts"))
    pairs = lines.select(F.col("line").alias("a"), F.col("counts").alias("x")).crossJoin(lines.select(F.col("line").alias("b"), F.col("counts").alias("y")))
    bound = F.expr(line_dedup.fewest_edits("x", "y", "length(a) - length(b)"))
    rows = pairs.select("a", "b", bound.alias("bound"), F.expr("levenshtein(a, b)").alias("edits"), F.expr("abs(length(a) - length(b))").alias("longer")).collect()
    assert all(r.longer <= r.bound <= r.edits for r in rows) and any(r.bound > r.longer for r in rows)
    assert all(r.bound == 0 for r in rows if sorted(r.a) == sorted(r.b))
