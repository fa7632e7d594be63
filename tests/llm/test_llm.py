"""The training-data operators on small hand-made tables: nulls, empty and long texts, ties, repeats, clashing columns, brute force."""

import base64
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import decontaminate, langid, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity
from factloom.llm.bpe import PrefixCounts, TokenIds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "the quick brown fox jumps over the lazy dog near the old river bank"


def texts():
    draw = np.random.default_rng(3)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "日本", "x"]
    made = [" ".join(draw.choice(words, n)) + "." for n in (3, 12, 40, 80, 200)]
    near = made[3].split(" ")
    near[70] = "changed"
    odd = ["", "   ", "\n\n", "a", "one two", "!!! ### $", LINE + "\n" + LINE.upper() + "\nother line of five words", "word " * 3000, "é\t日本  x\x0b y <|endoftext|> z"]
    return [*made, made[3], " ".join(near), *odd, None, made[1], "Same " * 30 + "\n" + LINE]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], "s", 1, 0.5, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, ids string").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_quality_rules_equal_plain_counts(docs, none):
    got = {r.doc_id: r for r in quality_rules.compression_bands(docs).collect()}
    assert len(got) == docs.count()
    for i, t in enumerate(texts()):
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        many = Counter(grams)
        covered = {p for k, g in enumerate(grams) if many[g] > 1 for p in range(k, k + 5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.compression_bands(none).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_compression_bands_reject_noise_and_repeats(spark):
    noise = "".join(chr(c) for c in np.random.default_rng(1).integers(0x4E00, 0x9000, 3000)) + " " + " ".join(f"w{k}" for k in range(20))
    repeat = " ".join(" ".join(f"{w}{k}" for w in "abcdefghijklmno") for k in ["q" * 300] * 1 for _ in range(1)) + " " + "y" * 9000
    rows = quality_rules.compression_bands(spark.createDataFrame([(1, noise), (2, repeat)], "doc_id long, text string")).collect()
    assert [r.base_failed for r in sorted(rows)] == [False, False]
    assert not any(r.kept for r in rows)


def test_a_clean_text_cannot_hide_a_random_part(spark, sf):
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    prose = [r.text.encode() for r in quality_rules.keep_good(good.select("doc_id", "text")).where("octet_length(text) >= 8192").orderBy("doc_id").limit(8).collect()]
    draw = np.random.default_rng(6)
    rows = []
    for i, t in enumerate(prose):
        clean = t[:8192].decode(errors="ignore")
        half, quarter, tail = (clean[: len(clean) * k // 8] + " " + base64.b64encode(draw.bytes(n)).decode() for k, n in ((4, 3072), (6, 1536), (7, 1536)))
        rows += [(10 * i + k, x) for k, x in enumerate((clean, half, quarter, tail))]
    kept = {r.doc_id % 10 for r in quality_rules.compression_bands(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert len(prose) >= 3 and kept == {0}


def test_language_id(spark, docs, none):
    en, fr = "the house of the people and their work in this land ", "la maison de les gens et leur travail dans cette ville "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 4), "en" if i % 2 else "fr") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, F.col("doc_id") % 5 != 0)
    out = langid.identify(table, model).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out)
    odd = {r.text: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert odd[None] == odd[""] == odd["!!! ### $"] == "und"
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.codewords(4).shape == (4, 7) and langid.codewords(12).shape[0] == 12


def test_toxicity_and_quality_classifier(spark, docs, none):
    draw = np.random.default_rng(5)
    plain = [f"w{k}a" for k in range(300)]
    rows = []
    for i in range(400):
        words = list(draw.choice(plain, 60))
        if i % 4 == 0:
            words[draw.integers(0, 60)] = "nastyword"
        rows.append((i, " ".join(words) if i % 3 else " ".join(f"### {w} |" for w in words), int(i % 4 == 0), int(i % 3 > 0)))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") < 300
    model = toxicity.fit(table, labels, learn)
    out = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert np.mean([out[i].tox_predicted == t for i, _, t, _ in rows if i >= 300]) > 0.97
    hit = next(out[i] for i, _, t, _ in rows if t and i >= 300)
    assert any(hit.text.encode()[s.start : s.end] == b"nastyword" for s in hit.segments)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    assert {r.tox_predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), learn)).collect()} == {0}
    good = quality_classifier.fit(table, labels, learn)
    judged = {r.doc_id: r.quality_predicted for r in quality_classifier.score(table, good).collect()}
    assert np.mean([judged[i] == q for i, _, _, q in rows if i >= 300]) > 0.97
    odd = quality_classifier.score(docs, good).collect()
    assert all(0 <= r.quality_score <= 1 for r in odd) and len(odd) == docs.count()
    assert quality_classifier.score(none, good).count() == 0


def test_maximal_segments_equal_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(200):
        s = np.round(draw.normal(-0.4, 1, 12), 2)
        total = np.cumsum(s)
        at = np.flatnonzero(s > 0)
        got = {(a, b) for a, b, _ in toxicity.maximal_segments(s, at, total[at] - s[at])}

        def split(lo, hi):
            best = max(((s[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 1e-12:
                return set()
            return {best[2:]} | split(lo, best[2]) | split(best[3], hi)

        assert got == split(0, len(s))


def test_prefix_counts_and_ids_equal_the_library(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), PrefixCounts(path)
    odd = ["don're we'll've 's 'r", "a \n\n  b\t\tc   ", "<|endoftext|>", "x<|endoftext|>y <|endof", "日本語 テキスト", "\x1c a\x1fb", " " * 70 + "a", "x 're", "ab" * 100]
    for t in [t[:150] for t in texts() if t] + odd:
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]
        assert counter.counts(t).tolist() == want
    rows = token_counts.prefix_token_counts(docs, path).collect()
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)
        steps = bytes(r.token_steps)
        assert token_counts.tokens_of_prefix(steps, len(r.text or "")) == n
    for r in token_counts.prefix_token_counts(docs, path, limit=10).collect():
        assert r.chars_in_limit == token_counts.longest_prefix(bytes(r.token_steps), 10)
    assert token_counts.prefix_token_counts(none, path).count() == 0
    short = token_counts.truncate_to_budget(token_counts.prefix_token_counts(docs, path), 10).collect()
    assert all(len(library.encode(r.truncated, add_special_tokens=False).ids) <= 10 for r in short)
    words = public_tokenizers.path("word_bpe_49k.json")
    library, ids = Tokenizer.from_file(words), TokenIds(words)
    for t in [t for t in texts() if t] + odd:
        assert np.frombuffer(ids.encode(t), ids.kind).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, length=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(texts()):
        pieces = sorted(by_doc[i])
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert sum((p[1] for p in pieces), []) == want and {p[2] for p in pieces} == {len(want)}
    for s, pieces in by_sequence.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 64 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(none, path).count() == 0
    whole = packing.sequences(packing.pack(docs, path, length=64)).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows)


def test_sharding(spark, docs, none):
    more = docs.union(docs.where("doc_id < 4"))
    rows = sharding.shard_rows(more, 4, key=9).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == more.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    n = len(rows)
    back = spark.createDataFrame(rows).select(F.expr(f"{sharding.permuted('4L * slot + shard', n, 9, True)} = row_number").alias("same")).collect()
    assert all(r.same for r in back)
    for n in (1, 2, 5, 97):
        places = spark.range(n).select(F.expr(sharding.permuted("id", n, 3)).alias("p")).collect()
        assert sorted(r.p for r in places) == list(range(n))
    assert sharding.shard_rows(none).count() == 0
    again = {(r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard_rows(more.repartition(7), 4, key=9).collect()}
    assert again == {(r.doc_id, r.size, r.shard, r.slot) for r in rows}


def test_jaccard_components_equal_brute_force(spark, docs, none):
    draw = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(400)]
    base = [list(draw.choice(vocabulary, n)) for n in (30, 60, 120)]
    rows = [(1000 + i, " ".join(x)) for i, x in enumerate(base)]
    for i in range(120):  # near copies of all degrees around the threshold
        words = list(base[i % 3])
        for k in draw.integers(0, len(words), draw.integers(0, 4)):
            words[k] = "y" + str(draw.integers(0, 1000))
        rows.append((2000 + i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    sets = {}
    for r in table.collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert ngram_join.jaccard_components(none).count() == 0
    kept = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert 5 not in kept and 3 in kept and {7, 8, 9} <= kept


def test_line_dedup(spark, docs, none):
    rows = [
        (1, LINE + "\nshort one\n" + "a second line that nobody else has written down"),
        (2, "new words first in this line here\n  " + LINE.upper() + "  \nshort one"),
        (3, LINE.replace("lazy", "lazi") + "\nend of this other document is here"),
        (4, LINE), (5, None), (6, ""), (7, "short one\n\nshort one"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(table, distance=12).collect()}
    assert out[1].text == rows[0][1] and out[1].n_removed == 0
    assert out[2].text == "new words first in this line here\nshort one"
    assert out[3].text == "end of this other document is here"
    assert (out[4].text, out[4].n_removed) == ("", 1)
    assert (out[5].text, out[5].n_lines, out[6].text, out[7].text) == (None, 0, "", rows[6][1])
    kept = line_dedup.drop_repeated_lines(table, distance=12)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, 7}
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(docs).count() == docs.count()


def test_no_copy_is_left_as_a_fragment_of_short_lines(spark):
    import corpus_pipeline

    chinese = "我们今天在北京的大学里学习新的语言和历史"
    rows = [(1, f"Haanth.\n{LINE}\nMenu\n  two  words "), (2, f"Haanth.\n{LINE}\nMenu\n  two  words "), (3, f"MENU\n\n{LINE.replace('lazy', 'lazi')}\nhaanth.")]
    rows += [(4, chinese), (5, chinese.replace("今", "明")), (6, "tab\tbetween\tall\tthe\twords\there"), (7, "tab\tbetween\tall\tthe\twords\thers"), (8, "one two three fous"), (9, "one two three four")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, table, "").collect()}
    assert kept == {i: t for i, t in rows if i in (1, 4, 6, 8, 9)}
    stay = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(table).collect()}
    assert stay[2] == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_lines_are_found_at_the_production_values(spark):
    draw = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = ["".join(draw.choice(letters, draw.integers(2, 9))) for _ in range(2000)]
    pairs = []
    for words in (5, 7, 9, 12, 16, 20, 30, 39):
        for k in range(30):
            line = " ".join(draw.choice(vocabulary, words))
            other = list(line)
            for at in draw.choice([i for i, c in enumerate(line) if c != " "], 1 + k % 2, replace=False):
                other[at] = "é"
            other = "".join(other)
            if 1 - edits(line, other) / max(len(line), len(other)) >= line_dedup.SIMILARITY:
                pairs.append((words, line, other))
    table = spark.createDataFrame([(2 * i + j, p[1 + j]) for i, p in enumerate(pairs) for j in range(2)], "doc_id long, text string")
    removed = {r.doc_id for r in line_dedup.dedup_lines(table).where("n_removed > 0").collect()}
    assert removed <= {2 * i + 1 for i in range(len(pairs))}
    for low, high in ((5, 9), (10, 19), (20, 39)):
        near = [2 * i + 1 in removed for i, p in enumerate(pairs) if low <= p[0] <= high]
        assert len(near) >= 50 and np.mean(near) >= 0.9


def test_links_of_real_lines_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    hashed = line_dedup.hashed_lines(docs)
    lines = hashed.select("line").distinct()
    most = f"cast(floor((1 - {line_dedup.SIMILARITY}) * greatest(length(a.line), length(b.line))) as int)"
    pairs = lines.alias("a").join(lines.alias("b"), F.expr(f"a.line < b.line and abs(length(a.line) - length(b.line)) <= {most}"))
    near = pairs.where(f"levenshtein(a.line, b.line, {most}) >= 0").select("a.line", F.col("b.line").alias("other")).collect()
    keep = {r.line: tuple(r.keep) for r in hashed.join(line_dedup.line_classes(docs, hashed), ["h1", "h2"]).select("line", "keep").distinct().collect()}
    found = sum(keep.get(r.line, 1) == keep.get(r.other, 2) for r in near)
    assert near and found >= 0.9 * len(near)


def test_lines_of_edit_similarity_above_four_fifths_are_linked(spark):
    other = LINE.replace("quick", "xxxxx").replace("jumps", "yyyyy")
    assert 0.8 <= 1 - edits(LINE, other) / len(LINE) < 0.9
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame([(1, LINE), (2, other)], "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 1}


def test_simhash_is_the_majority_of_distinct_word_hashes(spark):
    several = " ".join(f"w{k}" for k in range(200))
    lines = [LINE, "same " * 300, several, several + " w7" * 130, " ".join(f"v{k}" for k in range(40_000))]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    signed = line_dedup.signed_groups(line_dedup.hashed_lines(table.union(table)))
    assert {r.k for r in signed.collect()} == {2}
    got = {r.doc_id: (r.n_words, r.simhash % 2**64) for r in signed.collect()}
    vocabulary = sorted({w for t in lines for w in t.split()})
    hashes = {r.w: r.x % 2**64 for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("x")).collect()}
    for i, t in enumerate(lines):
        words = set(t.split())
        assert got[i] == (len(words), sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in words) > len(words)))


def test_block_max_wand_equals_full_scoring():
    draw = np.random.default_rng(4)
    vocabulary = [f"t{k}" for k in range(60)]
    index = decontaminate.build_index([(i, " ".join(draw.choice(vocabulary, draw.integers(3, 12)))) for i in range(300)])
    for _ in range(60):
        terms = sorted(draw.choice(len(index.terms), 15, replace=False).tolist())
        scores = Counter()
        for t in terms:
            for p, w in zip(index.postings[t], index.impacts[t]):
                scores[p] += w
        assert {p for p, _ in decontaminate.block_max_wand(index, terms, 0.5)} == {p for p, s in scores.items() if s >= 0.5 - 1e-9}


def test_decontamination(spark, docs, none):
    items = [(1, "Who wrote the famous book about the white whale at sea? It was Herman Melville of New York."), (2, None), (3, ""), (4, "single sentence item with quite rare words zyx wvu tsr")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(300))
    rows = [(1, filler + " " + items[0][1].upper() + " " + filler), (2, filler), (3, "Who wrote the famous book about the white whale at sea? nobody knows"), (4, items[3][1]), (5, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()} == {(1, 1), (4, 4)}
    kept = decontaminate.keep_unleaked(table.drop("leaks"), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 6}
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert len(decontaminate.indexes(bench, index_bytes=20)) > 1


def test_pipeline_stages_and_registration(spark, sf):
    import __spark_entry__
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    pieces = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    documents = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert ids and ids < documents
    leaked = {r.doc_id for r in __spark_entry__.queries()["op9_decontamination"](spark, sf).collect()}
    assert not ids & leaked


def test_merge_ranks_say_which_tokens_stand_together():
    import random

    import public_tokenizers
    from factloom.llm.bpe import PrefixCounts

    counter = PrefixCounts(public_tokenizers.path("byte_bpe_50k.json"))
    named = {i: t for t, i in counter.tokenizer.get_vocab().items()}
    plain = [i for i in named if i < len(counter.size) and (counter.size[i] == 1 or counter.rank[i] >= 0)]
    draw = random.Random(3)
    near = {}
    for i in plain:
        near.setdefault(named[i][0], []).append(i)
    for _ in range(20_000):
        a = draw.choice(plain)
        # half of the pairs come from the halves of a token, as these are the ones that merges join
        b = draw.choice(plain) if draw.random() < 0.5 else draw.choice(near[named[counter.second_half[a]][0]])
        alone = [t.id for t in counter.model.tokenize(named[a])] == [a]
        assert bool(counter.alone[a]) == alone
        if alone and counter.alone[b]:
            assert counter.together[a << 32 | b] == ([t.id for t in counter.model.tokenize(named[a] + named[b])] == [a, b]), (named[a], named[b])
    for run in ("a" * 300, "ab" * 200, "0" * 77, "\u00e9" * 90, "-" * 513):
        assert list(counter.counts(run)) == [len(counter.tokenizer.encode(run[:k]).ids) for k in range(1, len(run) + 1)]


def test_quality_scores_equal_plain_zstandard(spark, docs, none):
    import math

    import numpy as np
    import zstandard

    words = [t.encode() for t in texts() if t]
    big = [(b" %d " % i).join([w[:700], w[700:1400]]) for i, w in enumerate(words * 40) if w]
    # much text and a small size, so the dictionaries are trained ones
    good, bad = quality_classifier._dictionary(big[::2], 2048), quality_classifier._dictionary(big[1::2], 2048)
    assert sum(map(len, big[::2])) > 20 * 2048 and zstandard.ZstdCompressionDict(good).dict_id() != 0
    curve = np.array([3.0, -1.0, 0.5, 2.0, -0.7])

    def size(content: bytes, raw: bytes) -> int:
        entries = zstandard.ZstdCompressionDict(content) if content else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=entries, write_content_size=False, write_checksum=False, write_dict_id=False)
        total, at = 0, 0
        while at < len(raw):
            end = at + 1024 if len(raw) - at >= 1024 + 512 else len(raw)
            # a rest of half a chunk is a chunk, a shorter one belongs to the chunk before
            if len(raw) - end <= 512 and end < len(raw):
                end = len(raw)
            total, at = total + len(pack.compress(raw[at:end])), end
        return total

    for pair in ((good, bad), (b"".join(words)[-3000:], b"")):
        got = quality_classifier.score(docs, quality_classifier.Model(*pair, curve)).collect()
        assert len(got) == docs.count()
        for r in got:
            raw = (r.text or "").encode()
            n, g, b = len(raw), *(size(p, raw) if raw else 0 for p in pair)
            d = (b - g) / max(b + g, 1)
            assert (r.good_bytes, r.bad_bytes) == (g, b), (n, g, b)
            left = min(min(g, b) / n, 1.2) if n else 0.0
            z = 3 * d - math.tanh(12 * d) + 0.5 * left + 2 * math.log1p(n) / 10 - 0.7
            assert abs(r.quality_score - 1 / (1 + math.exp(-z))) < 1e-9 and abs(r.difference - d) < 1e-12


def test_language_model_and_decoding_equal_plain_python(spark):
    import math
    from collections import Counter

    rows = [(i, t[:400], f"L{i % 9}") for i, t in enumerate(t for t in texts() if t)][:90]
    docs = spark.createDataFrame([*rows, (900, "123 ...", None), (901, "", None)], "doc_id long, text string, lang string").coalesce(2)
    model = langid.fit(docs, F.lit(True))
    names = sorted({r[2] for r in rows})
    assert model.languages == names and model.code.shape == (9, 60)

    def buckets(text: str) -> Counter:
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
        found = Counter()
        for order in (2, 3, 4):
            for k in range(len(raw) - order + 1):
                gram = raw[k : k + order]
                if gram[:2] != b"  ":
                    found[((int.from_bytes(gram, "little") ^ (order * 0x51ED270B & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF) >> 16] += 1
        return found

    totals = {x: Counter() for x in names}
    for _, text, lang in rows:
        totals[lang].update(buckets(text))
    sums = {x: sum(c.values()) for x, c in totals.items()}
    seen = sorted(set().union(*totals.values()))
    weights = {}
    for b in range(60):
        sides = [[x for x, c in zip(names, model.code[:, b]) if c == s] for s in (1, -1)]
        assert abs(len(sides[0]) - len(sides[1])) <= 1
        for g in seen:
            one, other = (sum(totals[x][g] / max(sums[x], 1) for x in side) / len(side) for side in sides)
            weights[g, b] = math.log(one + 1e-7) - math.log(other + 1e-7)
    assert all(abs(model.weights[g, b] - w) < 1e-4 for (g, b), w in weights.items())

    for r in langid.identify(docs, model).collect():
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = buckets(r.text)
        n = max(sum(grams.values()), 1)
        z = [sum(k * weights[g, b] for g, k in grams.items()) / n * model.scale[b, 0] + model.scale[b, 1] for b in range(60)]
        loss = [sum(t * (math.log1p(math.exp(-abs(v))) + max(-v, 0)) for t, v in zip(model.trust, (a * int(c) for a, c in zip(z, word)))) for word in model.code]
        odds = [math.exp(min(loss) - x) for x in loss]
        share = sorted(((o / sum(odds), x) for o, x in zip(odds, names)), reverse=True)
        assert r.lang_pred == share[0][1] or share[0][0] - share[1][0] < 1e-3
        assert abs(r.score - share[0][0]) < 1e-2 and r.ambiguous == (r.margin < 0.2)
