"""Benchmark decontamination: BM25 over an inverted index of the test items, asked with every passage of every document.

Impacts are divided by the item's score for its own words, so one threshold serves all items.  Block-max WAND finds all items above
it: a passage is skipped as soon as upper bounds (of its terms, then of blocks of postings) stay below.  What it retrieves is
verified by the share of the item's question and of its answer (word trigrams) that the document holds there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.textbatch import LETTER_BYTES, LOWER, broadcast_fields, byte_class, span_hashes, spans, windows, with_text_columns

TERM_BYTES = LETTER_BYTES | byte_class(b"0123456789")
#: text of test items that one index may hold; more items are asked in several passes
INDEX_BYTES = 32 << 20
BLOCK = 16
#: bounds that are held at a time, and passages that are asked at a time
BOUNDS = 1 << 20
PASSAGES = 1024
THRESHOLD = 0.6
OVERLAP = 0.6
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """Postings of all terms one after another, in order of (term, item place).  A block holds the postings of one term for items of
    ``BLOCK`` neighbouring places, so blocks of different terms line up."""

    terms: np.ndarray  # sorted hashes
    lists: np.ndarray  # per term and one more: its first posting
    places: np.ndarray  # per posting: item place
    weights: np.ndarray  # per posting: impact
    tops: np.ndarray  # per term: largest impact
    block_lists: np.ndarray  # per term and one more: its first block
    blocks: np.ndarray  # per block: its number, place // BLOCK
    block_tops: np.ndarray  # per block: largest impact
    block_cuts: np.ndarray  # per block and one more: its first posting
    items: list[int]
    questions: list[np.ndarray]  # per item: hashes of its word trigrams, or of all its words if there are fewer
    answers: list[np.ndarray]
    window: int  # words of a passage; passages start at every half of it, so each item lies whole in one

    @property
    def postings(self) -> list[np.ndarray]:
        return np.split(self.places, self.lists[1:-1])

    @property
    def impacts(self) -> list[np.ndarray]:
        return np.split(self.weights, self.lists[1:-1])


def _words(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    mask, starts, ends, _ = spans(data, np.array([0, len(data)]), TERM_BYTES)
    return span_hashes(data, mask, starts, ends)[0]


def _grams(words: np.ndarray) -> np.ndarray:
    n = min(3, len(words))
    return np.unique(windows(words, np.array([len(words)]), n)[0]) if n else np.zeros(0, np.uint64)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer; of a single sentence, its last third of words."""
    parts = [p for p in regex.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def build_index(items: Sequence[tuple[int, str]]) -> Index:
    """Items without a word are left out: nothing can overlap with them."""
    worded = [(i, w, t) for i, t in items if t and len(w := _words(t))]
    frequency: dict[int, dict[int, int]] = defaultdict(dict)
    for place, (_, words, _) in enumerate(worded):
        for term, n in zip(*(x.tolist() for x in np.unique(words, return_counts=True))):
            frequency[term][place] = n
    length = np.array([len(w) for _, w, _ in worded], float)
    mean = length.mean() if len(length) else 1.0
    terms = sorted(frequency)
    weights: list[dict[int, float]] = []
    own = np.zeros(len(worded))
    for term in terms:
        found = frequency[term]
        idf = np.log(1 + (len(worded) - len(found) + 0.5) / (len(found) + 0.5))
        weights.append({p: idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length[p] / mean)) for p, n in sorted(found.items())})
        for p, w in weights[-1].items():
            own[p] += w
    lists = np.concatenate(([0], np.cumsum([len(w) for w in weights], dtype=np.int64)))
    places = np.array([p for w in weights for p in w], np.int64)
    impacts = np.array([x for w in weights for x in w.values()]) / own[places]
    term_of = np.repeat(np.arange(len(terms)), np.diff(lists))
    first = np.ones(len(places), bool)
    first[1:] = (np.diff(term_of) != 0) | (np.diff(places // BLOCK) != 0)
    cuts = np.flatnonzero(first)
    halves = [split_item(t) for _, _, t in worded]
    return Index(
        terms=np.array(terms, np.uint64), lists=lists, places=places, weights=impacts, tops=np.maximum.reduceat(impacts, lists[:-1]) if terms else np.zeros(0),
        block_lists=np.searchsorted(cuts, lists), blocks=places[cuts] // BLOCK, block_tops=np.maximum.reduceat(impacts, cuts) if terms else np.zeros(0),
        block_cuts=np.append(cuts, len(places)), items=[i for i, _, _ in worded],
        questions=[_grams(_words(q)) for q, _ in halves], answers=[_grams(_words(a)) for _, a in halves], window=max(64, 2 * int(length.max(initial=1))))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for each member of the ranges start..stop-1."""
    sizes = np.maximum(stops - starts, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + starts[owner]


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item place, score) of every score of ``threshold`` or more, by passage and place, for distinct (passage, term) in
    order of the passage.

    Block-max WAND over many passages at once: a passage is left when the tops of its lists stay below the threshold, a block of items
    when the tops of its blocks do; postings are read in the other blocks only.
    """
    low = threshold - 1e-9
    n_blocks = -(-len(index.items) // BLOCK)
    number = np.unique(passage, return_inverse=True)[1] if len(passage) else passage
    promising = np.bincount(number, index.tops[term])[number] >= low if len(passage) else np.zeros(0, bool)
    passage, term = passage[promising], term[promising]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    step = max(1, BOUNDS // max(n_blocks, 1))
    for k in range(0, len(begins), step):
        part = slice(begins[k], begins[k + step] if k + step < len(begins) else len(passage))
        names, local = np.unique(passage[part], return_inverse=True)
        owner, block = _ranges(index.block_lists[term[part]], index.block_lists[term[part] + 1])
        cell = local[owner] * n_blocks + index.blocks[block]
        live = (np.bincount(cell, index.block_tops[block]) >= low)[cell]
        owner, block = owner[live], block[live]
        entry, posting = _ranges(index.block_cuts[block], index.block_cuts[block + 1])
        cells, place_of = np.unique(cell[live], return_inverse=True)
        scores = np.bincount(place_of[entry] * BLOCK + index.places[posting] % BLOCK, index.weights[posting], len(cells) * BLOCK)
        best = np.flatnonzero(scores >= low)
        hit = cells[best // BLOCK]
        found.append((names[hit // n_blocks], hit % n_blocks * BLOCK + best % BLOCK, scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def block_max_wand(index: Index, terms: Sequence[int], threshold: float) -> list[tuple[int, float]]:
    """All (item place, score) with a score of ``threshold`` or more for the distinct ``terms`` of one passage."""
    term = np.array(terms, np.int64)
    _, places, scores = retrieve(index, np.zeros(len(term), np.int64), term, threshold)
    return list(zip(places.tolist(), scores.tolist()))


def _leaks(index: Index, hashes: np.ndarray, counts: np.ndarray, threshold: float, overlap: float) -> list[list[dict]]:
    """Verified items of each document, by its words' hashes: the best passage of each."""
    half, cut = index.window // 2, np.concatenate(([0], np.cumsum(counts)))
    place = np.searchsorted(index.terms, hashes)
    place[place == len(index.terms)] = 0
    known = index.terms[place] == hashes
    bound = np.concatenate(([0.0], np.cumsum(np.where(known, index.tops[place], 0.0))))
    doc, starts = _ranges(np.zeros(len(counts), np.int64), np.where(counts > 0, np.maximum(-(-(counts - half) // half), 1), 0))
    starts = cut[doc] + starts * half
    stops = np.minimum(starts + index.window, cut[doc + 1])
    asked = np.flatnonzero(bound[stops] - bound[starts] >= threshold - 1e-6)
    best: list[dict[int, dict]] = [{} for _ in counts]
    for k in range(0, len(asked), PASSAGES):
        some = asked[k : k + PASSAGES]
        passage, word = _ranges(starts[some], stops[some])
        passage, word = passage[known[word]], word[known[word]]
        pairs = np.unique(passage * len(index.terms) + place[word])
        grams: dict[int, np.ndarray] = {}  # of the passage at hand
        for p, item, score in zip(*(x.tolist() for x in retrieve(index, pairs // len(index.terms), pairs % len(index.terms), threshold))):
            d, a, b = int(doc[some[p]]), starts[some[p]], stops[some[p]]
            if score <= best[d].get(item, {"score": -1})["score"]:
                continue
            if p not in grams:
                grams = {p: np.concatenate([windows(hashes[a:b], np.array([b - a]), n)[0] for n in (1, 2, 3)])}
            held = [x if not len(x) else np.isin(x, grams[p]) for x in (index.questions[item], index.answers[item])]
            shares = [float(x.mean()) if len(x) else 1.0 for x in held]
            if min(shares) >= overlap:
                best[d][item] = {"item_id": index.items[item], "score": score, "question_overlap": shares[0], "answer_overlap": shares[1], "word_start": int(a - cut[d])}
    return [[x[k] for k in sorted(x)] for x in best]


LEAK = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,word_start:int>>"


def with_leaks(df: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``leaks``: the test items that each whole text holds (item_id, BM25 score relative to the item's own, share of its
    question and answer, first word of the best passage).  Null, empty and wordless texts hold none; nothing is shuffled."""
    load = broadcast_fields(df.sparkSession, index)

    def start():
        index = load()

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            folded = LOWER[data]
            mask, starts, ends, counts = spans(folded, offsets, TERM_BYTES)
            [hashes] = span_hashes(folded, mask, starts, ends)
            found = _leaks(index, hashes, counts, threshold, overlap) if len(index.terms) else [[] for _ in counts]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("word_start", pa.int32())]))
            return [pa.array(found, kind)]

        return work

    return with_text_columns(df, text, f"leaks {LEAK}", start, keep)


def indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> list[Index]:
    """One index per block of test items; a block holds about ``index_bytes`` of text, whatever the size of the benchmark.  Items
    with a null id or text are left out; items with equal texts are items of their own."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // index_bytes + 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [build_index([(r.item_id, r.text) for r in items.where(block == k).orderBy("item_id").collect()]) for k in range(blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word_start): every verified pair."""
    out = None
    for index in indexes(benchmark):
        rows = with_leaks(docs.select("doc_id", "text"), index, keep=["doc_id"], **limits).select("doc_id", F.inline("leaks"))
        out = rows if out is None else out.unionByName(rows)
    return out


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The documents that hold no test item, with their columns as they were."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    for index in indexes(benchmark):
        rows = with_leaks(rows, index, **limits).where(F.size("leaks") == 0).drop("leaks")
    return rows.select("row.*")
