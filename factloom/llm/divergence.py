"""Source divergence audit: which sources of a language use other words than the rest, and which words these are.

Documents become exact sparse count vectors as CountVectorizer builds them (one vocabulary per language, a least number of documents,
no limit to its size), and the vectors of a group are summed, never as dense ones.  The class itself is not used: its vocabulary
passes through the driver and is broadcast whole, with no bound on it, and it costs several microseconds a token.  Here the vectors
of some megabytes of text are built at once in Arrow batches, added up by (lang, source), and meet in a DataFrame aggregate; the
vocabulary is a table.  Two groups are compared over the terms that at least one of them has; all other terms of the language share
one value, which is multiplied by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.checkpoints import stored
from factloom.llm.textbatch import LETTER_BYTES, LOWER, slices, spans

MIN_DOCS, TOP_TERMS = 10, 10
#: text that a task turns into vectors at once
SLICE_BYTES = 8 << 20
#: shares are counted in parts of 10^9; 10^9 is reached in steps of 10^3 so that no product leaves 64 bits
STEPS, STEP = 3, 1000
PARTIAL = "lang string, source string, term string, n long, docs long"


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) in whole numbers, for count <= total < 9 * 10^15."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(STEPS):
        out = out * STEP + F.call_function("div", rest * STEP, total)
        rest = (rest * STEP) % total
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def count_vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of whole texts: (terms, document, place of its term in terms, count), one entry per document and term.

    A term is a run of ASCII letters and characters beyond ASCII; only A-Z are lower-cased.
    """
    mask, starts, ends, per_text = spans(data, offsets, LETTER_BYTES)
    letters = LOWER[data[mask]]
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
    terms, width = words.dictionary, max(len(words.dictionary), 1)
    keys = np.repeat(np.arange(len(per_text), dtype=np.int64), per_text) * width + words.indices.to_numpy().astype(np.int64)
    entries, counts = np.unique(keys, return_counts=True)
    return terms, entries // width, entries % width, counts


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of each slice of texts, summed by (lang, source): (lang, source, term, n, docs)."""
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", SLICE_BYTES):
            terms, doc, place, counts = count_vectors(data, offsets)
            labels = list(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist()))
            numbers = {g: i for i, g in enumerate(dict.fromkeys(labels))}
            group = np.array([numbers[g] for g in labels], np.int64)
            keys = group[doc] * max(len(terms), 1) + place
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
            n = np.add.reduceat(counts[order], first) if len(first) else first
            docs = np.diff(np.append(first, len(ordered)))
            owner, term = ordered[first] // max(len(terms), 1), ordered[first] % max(len(terms), 1)
            names = [pa.array([g[k] for g in numbers], pa.string()).take(pa.array(owner)) for k in (0, 1)]
            columns = [*names, terms.take(pa.array(term)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def group_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(id, lang, term, n) of the terms in at least ``min_docs`` documents of their language, and (lang, source, id, n): their
    occurrences in each group that has them."""
    partial = docs.select("lang", "source", "text").mapInArrow(_partial_sums, PARTIAL)
    sums = stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = sums.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    # ids are only names; they are fixed by being stored
    kept = stored(kept.select(F.monotonically_increasing_id().alias("id"), "lang", "term", "n"), "kept-terms")
    counts = sums.select("lang", "source", "term", "n").join(kept.select("lang", "term", "id"), ["lang", "term"])
    return kept, counts.select("lang", "source", "id", "n")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int | None = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source); ``docs`` has text, lang, source (null: '').

    part ``pair``: how far each other source of the language is away, all of them; part ``term``: the terms that the group uses more
    than its language does, the first ``top_terms`` (None: all).  Ranks go by value (high first), then item by its UTF-8 bytes.
    A group without terms has the smoothed shares of an empty one; a language without kept terms has pairs of value 0.  Repeated
    rows count as often as they come; an empty table has no groups.  Counts must stay below 9 * 10^15 a language.  Memory of a task
    follows SLICE_BYTES and the longest text.
    """
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = stored(docs.select("lang", "source").distinct(), "groups")
    kept, counts = group_counts(docs, min_docs)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    counts = stored(counts, "group-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("total", zero) + 2 * F.coalesce("v", zero)).alias("whole"))
    # p0: the share of a term that the group lacks
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(2).cast("long"), F.col("whole"))).otherwise(zero)), "groups")

    uses = counts.join(groups, ["lang", "source"]).select("lang", "source", "id", "n", "p0", share(F.col("n") + 2, F.col("whole")).alias("p"))
    return _pairs(groups, uses).unionByName(_terms(uses, kept, top_terms))


def _pairs(groups: DataFrame, uses: DataFrame) -> DataFrame:
    """f summed over all kept terms for each two sources of a language: f(p0, p0) for every term, corrected by the terms that
    one has (counted once per different p), corrected again by the terms that both have."""
    a, b = F.col("a.p"), F.col("b.p")
    a0, b0 = F.col("a.p0"), F.col("b.p0")
    neither = divergence(a0, b0)
    one, two = F.col("a.source"), F.col("b.source")

    def pairs(left: DataFrame, right: DataFrame, on, value: Column) -> DataFrame:
        rows = left.alias("a").join(right.alias("b"), on)
        return rows.select(F.col("a.lang").alias("lang"), F.least(one, two).alias("s1"), F.greatest(one, two).alias("s2"), value.alias("f"))

    same_lang = F.col("a.lang") == F.col("b.lang")
    some = groups.where("v > 0")
    base = pairs(groups, groups, same_lang & (one < two), F.when(F.col("a.v") > 0, F.col("a.v") * neither).otherwise(0))
    alike = uses.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("h"))
    single = pairs(alike, some, same_lang & (one != two), F.col("a.h") * (divergence(a, b0) - neither))
    both = pairs(uses, uses, (F.col("a.id") == F.col("b.id")) & (one < two), divergence(a, b) - divergence(a, b0) - divergence(a0, b) + neither)
    summed = [t.groupBy("lang", "s1", "s2").agg(F.sum("f").alias("f")) for t in (base, single, both)]
    total = reduce(DataFrame.unionByName, summed).groupBy("lang", "s1", "s2").agg(F.sum("f").alias("value"))
    ends = F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))
    rows = total.select("lang", F.explode(ends).alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def _terms(uses: DataFrame, kept: DataFrame, top: int | None) -> DataFrame:
    wholes = kept.groupBy("lang").agg((F.sum("n") + 2 * F.count("*")).alias("whole"))
    usual = kept.join(wholes, "lang").select("id", "term", share(F.col("n") + 2, F.col("whole")).alias("q"))
    above = uses.join(usual, "id").where("p > q")
    rows = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
