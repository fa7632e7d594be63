"""Jaccard self-join on word 5-grams by a grouped prefix join, as components.

Two sets that are similar enough share a token among their first few in any one order of all tokens; the order here puts tokens of
rare hash buckets first.  Equal sets are one node; nodes with the same first tokens and the same size are one group, and only groups
are listed under their tokens.  Listed groups are filtered by size and by what can still follow a shared token, expanded to their
members, filtered by an exact bound from parity bitmaps, and verified on whole sets.

Links are found in two steps, so that a large group of near copies does not become all its pairs.  First each node of a list is
compared with two nodes of the list.  What links joins components, and this is done once more; then all pairs of a list that are
still in different components are compared.  Pairs inside one component need no comparison, so no component is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.checkpoints import cut, discard, stored
from factloom.llm.components import connected_components
from factloom.llm.textbatch import LOWER, WORD_BYTES, mix64, slices, span_hashes, spans, sums_by_text, windows

SHINGLE = 5
BUCKETS = 1 << 18
#: fewest and most parity bits of a set
BITS = (1024, 1 << 16)
#: ids that may be broadcast to pick texts (8 bytes each); beyond it the texts are joined by a shuffle
BROADCAST_IDS = 2_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of a slice; a text with fewer words has its whole sequence as its one shingle."""
    folded = LOWER[data]
    mask, starts, ends, counts = spans(folded, offsets, WORD_BYTES)
    [words] = span_hashes(folded, mask, starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes, at = windows(words, counts, size)
    parts, owners = [hashes], [owner[at]]
    first = np.cumsum(counts) - counts
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            sums = np.zeros(len(short), np.uint64)
            for k in range(n):
                sums = mix64(sums + words[first[short] + k] + np.uint64(n))
            parts.append(sums)
            owners.append(short)
    return np.concatenate(parts), np.concatenate(owners)


def ordered_sets(data: np.ndarray, offsets: np.ndarray, levels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens per text): each text's distinct shingles, rarest bucket first (by hash alone without ``levels``)."""
    hashes, owner = shingles(data, offsets)
    rank = owner if levels is None else (owner << 8) | levels[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    order = np.lexsort((hashes, rank))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(offsets) - 1)


def _signatures(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    return tuple(sums_by_text(mix64(tokens + np.uint64(seed)), counts).astype(np.uint64).view(np.int64) for seed in (11, 0x5851F42D4C957F2D))


def _bitmaps(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Parity bits of each set: a bit is set if an odd number of tokens fall on it.  A set gets as many bits as it has tokens, rounded up
    to a power of two within BITS, else the bits of large sets are odd by chance and bound nothing."""
    low, high = BITS
    sizes = np.clip(1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), low, high)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(counts)), counts)
    cells = np.bincount(begin[owner] + (mix64(tokens) & (sizes[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=int(sizes.sum()))
    packed = np.packbits((cells & 1).astype(np.uint8))
    return [packed[at : at + n].tobytes() for at, n in zip((begin // 8).tolist(), (sizes // 8).tolist())]


def _differing(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Differing bits of each pair of bitmaps; the longer one is folded to the length of the other."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(left, right)], np.int64).reshape(-1, 2)
    out = np.zeros(len(left), np.int64)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(axis=1))
        least = int(size.min())
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at]), np.uint8).reshape(len(at), -1, least), axis=1) for side in (left, right))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _bucket_levels(docs: DataFrame) -> np.ndarray:
    """How often each hash bucket occurs in all documents, in steps of a fifth: one byte per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                n += np.bincount((shingles(data, offsets)[0] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    seen = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS)
    n[seen["bucket"].to_numpy(np.int64)] = seen["n"].to_numpy(float)
    return np.minimum(np.rint(4 * np.log2(n + 1)), 255).astype(np.uint8)


def _described(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """Per document: n, signatures, group and bitmap of its set, and its first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                tokens, n = ordered_sets(data, offsets, levels)
                first, second = _signatures(tokens, n)
                heads = np.where(n > 0, n - (3 * n + 3) // 4 + 1, 0)
                begin = np.cumsum(n) - n
                at = np.repeat(begin, heads) + np.arange(int(heads.sum())) - np.repeat(np.cumsum(heads) - heads, heads)
                head_tokens = tokens[at]
                group = mix64(sums_by_text(mix64(head_tokens + np.uint64(29)), heads).astype(np.uint64) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                bits = _bitmaps(tokens, n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(heads))).astype(np.int32)), pa.array(head_tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(first), pa.array(second), pa.array(group), pa.array(bits, pa.binary()), lists],
                                                 ["doc_id", "text_hash", "n", "s1", "s2", "gid", "bits", "head"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long, gid long, bits binary, head array<long>")


def _within_bound(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that size and bitmaps allow: the overlap is at most (|A| + |B| - differing bits) / 2."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            differing = _differing(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            fine = pa.array(7 * ((n - differing) // 2) >= 3 * n)
            yield pa.RecordBatch.from_arrays([batch.column(s).filter(fine) for s in "ab"], ["a", "b"])

    sized = pairs.where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose whole sets are similar enough.  Only the texts of nodes in a pair are read again."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep", "s1", "s2"), "node")
    involved = cut(involved)
    ids = involved.select(F.col("rep").alias("doc_id")).distinct()
    if involved.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                tokens, n = ordered_sets(data, offsets, None)
                first, second = _signatures(tokens, n)
                ends = np.cumsum(n)
                sets = [tokens[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(first), pa.array(second), pa.array(sets, pa.binary())], ["rep", "s1", "s2", "tokens"])

    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "rep long, s1 long, s2 long, tokens binary")
    sets = sets.join(involved, ["rep", "s1", "s2"]).dropDuplicates(["node"]).select("node", "tokens")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("tokens").alias(f"set_{side}")), side)

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= 75 * (len(x) + len(y) - both))
            keep = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(s).filter(keep) for s in "ab"], ["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(same, "a long, b long")


def _spread(rows: DataFrame) -> DataFrame:
    """Posting lists that hold several components, with two comparison nodes for each: that with the largest share of tokens that
    others have too (an original among its copies), and that with the smallest id."""
    dealt = rows.repartition("tok")
    seen = F.struct("node", "comp", "n", "place")
    ends = dealt.groupBy("tok").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.max_by(seen, F.struct("shared", "rep")).alias("hub"), F.min_by(seen, "rep").alias("lo")).where("c1 <> c2").drop("c1", "c2")
    return dealt.join(ends, "tok")


def _against(spread: DataFrame) -> DataFrame:
    """Pairs of each node with its lists' comparison nodes, where size and place allow a link."""
    out = None
    for end in ("hub", "lo"):
        fits = f"""comp <> {end}.comp and 4 * least(n, {end}.n) >= 3 * greatest(n, {end}.n)
                   and 7 * least(n - place, {end}.n - {end}.place) >= 3 * (n + {end}.n)"""
        pairs = spread.where(fits).select(F.least("node", f"{end}.node").alias("a"), F.greatest("node", f"{end}.node").alias("b"))
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def _with_components(rows: DataFrame, component: DataFrame) -> DataFrame:
    return rows.drop("comp").join(component.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles (distinct), component_id (smallest doc_id reachable by links of
    Jaccard similarity 0.75 or more) and representative (smallest doc_id with an equal set).

    Null, empty and wordless texts have no shingle and are linked with nothing.  Rows with equal ids and different texts are
    documents of their own; equal texts are one node.  A row without an id keeps a null component.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), _text_hash("text").alias("text_hash"))
    wide = stored(_described(docs, _bucket_levels(docs)), "sets")
    narrow = stored(wide.select("doc_id", "text_hash", "n", "s1", "s2"), "signatures")
    linked = wide.where("n > 0 and doc_id is not null")
    nodes = stored(
        linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits").alias("bits")).withColumn("node", F.monotonically_increasing_id()),
        "nodes")

    # dealt once: the rows of a token meet, and tokens of one row go
    all_posts = linked.select(F.posexplode("head").alias("place", "tok"), "gid").select("tok", "gid", "place").repartition("tok")
    shared = all_posts.withColumn("k", F.count("*").over(Window.partitionBy("tok"))).where("k > 1")
    posts = stored(shared.groupBy("tok", "gid").agg(F.first("place").alias("place")), "posts")
    discard(wide)

    # of a run of tokens that two documents share in the same order, only the first needs to bring them together
    of_group = Window.partitionBy("gid")
    placed = posts.withColumns({"before": F.lag(F.struct("tok", "place")).over(of_group.orderBy("place")), "k": F.count("*").over(of_group)})
    placed = placed.select("tok", "gid", "place", "k", F.when(F.col("before.place") == F.col("place") - 1, F.col("before.tok")).alias("before"))
    members = nodes.select("gid", "node", "rep", "n")
    rows = placed.join(members, "gid").select("tok", "node", "rep", "n", "place", "before", (F.col("k") / F.col("n")).alias("shared"), F.col("node").alias("comp"))
    rows = stored(_spread(rows), "lists")
    discard(posts)

    compared = cut(_within_bound(_against(rows), nodes))
    links = cut(_verified(compared, docs, nodes))
    component = cut(connected_components(links))

    rest_rows = stored(_spread(_with_components(rows.drop("hub", "lo"), component)), "lists")
    discard(rows)
    again = cut(_within_bound(_against(rest_rows), nodes).join(compared, ["a", "b"], "left_anti"))
    if not again.isEmpty():
        links = cut(links.union(_verified(again, docs, nodes)))
        component = cut(connected_components(links))
    rows = _with_components(rest_rows.drop("hub", "lo"), component)
    rows = rows.select("tok", "comp", "node", "n", "place", "before").repartition("tok")
    mixed = rows.groupBy("tok").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("tok")
    rows = stored(rows.join(mixed, "tok"), "lists")
    other = rows.select("tok", *(F.col(c).alias(f"{c}_b") for c in ("comp", "node", "n", "place", "before")))
    fits = """comp < comp_b and 4 * least(n, n_b) >= 3 * greatest(n, n_b)
              and 7 * least(n - place, n_b - place_b) >= 3 * (n + n_b) and (before is null or before_b is null or before <> before_b)"""
    rest = rows.join(other, "tok").where(fits).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    rest = cut(_within_bound(rest.join(compared.union(again), ["a", "b"], "left_anti"), nodes))
    if not rest.isEmpty():
        links = links.union(_verified(rest, docs, nodes))
        component = cut(connected_components(links))

    named = nodes.join(component, "node", "left").select("s1", "s2", "rep", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(smallest, "component").select("s1", "s2", "rep", "component_id")
    lone = narrow.where("n = 0 or doc_id is null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("representative"))
    joined = narrow.where("n > 0 and doc_id is not null").join(classes, ["s1", "s2"])
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("rep").alias("representative")).unionByName(lone)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with its columns as they were: that with the smallest id, then the smallest hash of its text.
    A row goes by its id and its text, so a different text under the id of a removed copy stays.  Rows without shingles or id all stay.
    """
    found = jaccard_components(docs).where("n_shingles > 0 and doc_id is not null")
    rows = stored(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.first("component_id").alias("component_id")), "rows")
    kept = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    judged = rows.join(kept, "component_id").withColumn("stays", F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.text_hash") == F.col("text_hash")))
    # only rows that go or come several times are named
    named = judged.where("not stays or copies > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "stays")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), _text_hash("text").alias("own_hash"))
    met = packed.join(named, (F.col("own_id") == F.col("id")) & (F.col("own_hash") == F.col("hash")), "left")
    single = met.where("stays is null").select("row")
    # equal rows: those with other columns apart are told by nothing, so any one of them stays
    repeated = met.where("stays").groupBy("own_id", "own_hash").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
