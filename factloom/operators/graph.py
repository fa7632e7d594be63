"""Import graphs.

Edges: (repo_id, src, dst, is_external, is_cross_package, raw_import).  Resolution is a pair of equi-joins against
narrow, pre-reduced lookup tables; a file or package that most imports point at is a hot key on the stream side only, whose rows
are dealt over several tasks (``joins.lookup_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.checkpoints import cut, stored
from factloom.functions.joins import ROWS_PER_TASK, lookup_join
from factloom.functions.paths import basename, extname, resolve_relative
from factloom.functions.ranking import top_k_per_group

#: edges of a repository that one task solves, after trimming
LOCAL_EDGES = 500_000
#: rows of solved repositories that go back to Spark at once
ROWS_PER_BATCH = 10_000


def resolution_stems(files: DataFrame) -> DataFrame:
    """(repo_id, stem, target): the file that an extension-less import of ``stem`` resolves to.

    Every file answers to its own path (rank 0), to its path without a known extension, and to its directory when
    it is an index file.  Keeping the best rank per stem here means that a lookup returns at most one row.  A rank names what was cut
    off, so the rank and the stem tell the file: a minimum of numbers, without a sort.  Stems are nearly unique, so rows are dealt by
    stem first: the minimum and the lookup share one shuffle.
    """
    path = F.col("path")
    suffixes = ["", *signals.RESOLVE_EXTENSIONS, *signals.RESOLVE_INDEXES]

    def stem_of(suffix: str, rank: int, least: int) -> Column:
        """A name is no extension, so something stands before one (``least`` characters)."""
        fits = path.endswith(suffix) & (F.length(path) >= len(suffix) + least)
        return F.when(fits, F.struct(F.lit(rank).alias("rank"), F.left(path, F.length(path) - len(suffix)).alias("stem")))

    n = 1 + len(signals.RESOLVE_EXTENSIONS)
    # a path ends with one extension and one index name at most
    stems = F.array(
        F.struct(F.lit(0).alias("rank"), path.alias("stem")),
        F.coalesce(*[stem_of(x, i, 1) for i, x in enumerate(suffixes[:n]) if i]),
        F.coalesce(*[stem_of(x, i, 0) for i, x in enumerate(suffixes) if i >= n]),
    )
    rows = files.select("repo_id", F.explode(stems).alias("r")).where("r is not null").select("repo_id", "r.stem", "r.rank")
    best = rows.repartition("repo_id", "stem").groupBy("repo_id", "stem").agg(F.min("rank").alias("rank"))
    cut_off = F.get(F.array(*[F.lit(x) for x in suffixes]), F.col("rank"))
    return best.select("repo_id", "stem", F.concat("stem", cut_off).alias("target"))


def _first_package(distinct: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports (distinct repo_id, raw_import) of workspace packages: the import equals a package name or continues it with '/'.

    The prefix condition becomes an equi-join: the '/'-prefixes of an import are exploded and looked up.  The first
    package in manifest order wins.
    """
    pieces = F.split("raw_import", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    prefixes = F.when(F.col("raw_import").contains("/"), prefixes).otherwise(F.array("raw_import"))
    names = packages.filter("package_name is not null").groupBy("repo_id", "package_name").agg(
        F.min_by("package_path", "manifest_path").alias("package_path"), F.min("manifest_path").alias("manifest_path")
    )
    hit = distinct.select("repo_id", "raw_import", F.explode(prefixes).alias("package_name")).join(names, ["repo_id", "package_name"])
    return hit.groupBy("repo_id", "raw_import").agg(
        F.min_by(F.struct("package_name", "package_path"), "manifest_path").alias("pkg")
    )


def is_local_import(raw: Column) -> Column:
    return raw.startswith(".") | raw.startswith("/") | raw.startswith("~")


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Edges of all imports: workspace packages, external packages as they are, relative ones by lookup.
    Relative imports that resolve to nothing are dropped; package imports fall back to the bare directory.

    Only imports that may name a file meet the lookup table: external packages (usually the most frequent names) leave
    after the package join, relative imports never enter it.  A package name does not begin with '.', '/' or '~'.
    A target of more than ``rows_per_task`` imports is spread over tasks.  ``imports`` is read several times.
    """
    raw = F.col("raw_import")
    named = imports.filter(~is_local_import(raw)).select("repo_id", "path", "import_no", "raw_import")
    # one count of the named imports tells the distinct ones and the frequent ones
    uses = stored(named.groupBy("repo_id", "raw_import").count(), "import-names")
    hits = _first_package(uses.drop("count"), packages.filter(~is_local_import(F.col("package_name"))))
    matched = lookup_join(named, hits, ["repo_id", "raw_import"], "left", rows_per_task, counts=uses)
    sub = F.regexp_replace(F.substring(raw, F.length("pkg.package_name") + 1, F.length(raw)), "^/", "")
    in_package = F.concat(F.col("pkg.package_path"), F.when(sub != "", F.concat(F.lit("/"), sub)).otherwise(F.lit("")))

    def placed_rows(df: DataFrame, stem: Column, external: Column, crosses: Column) -> DataFrame:
        return df.select(
            "repo_id", F.col("path").alias("src"), "import_no", "raw_import", external.alias("is_external"), crosses.alias("is_cross_package"),
            stem.alias("stem"),
        )

    in_pkg = F.col("pkg").isNotNull()
    local = placed_rows(imports.filter(is_local_import(raw)), resolve_relative(F.col("path"), raw), F.lit(False), F.lit(False))
    # narrow rows, stored: external ones pass, the others are counted by their target and then joined
    placed = stored(local.unionByName(placed_rows(matched, F.when(in_pkg, in_package), ~in_pkg, in_pkg)), "import-stems")
    external = placed.where("is_external").select(
        "repo_id", "src", raw.alias("dst"), "is_external", "is_cross_package", "raw_import", "import_no"
    )
    wanted = placed.where("not is_external").drop("is_external")
    found = lookup_join(wanted, resolution_stems(files), ["repo_id", "stem"], "left", rows_per_task)
    dst = F.coalesce("target", F.when(F.col("is_cross_package"), F.col("stem")))
    inside = found.select(
        "repo_id", "src", dst.alias("dst"), F.lit(False).alias("is_external"), "is_cross_package", "raw_import", "import_no"
    )
    return external.unionByName(inside.filter("dst is not null"))


def internal(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("is_external"))


def degree_counts(edges: DataFrame) -> DataFrame:
    """(repo_id, path, inbound, outbound) over internal edges: both ends are counted in one combined aggregate."""
    ends = F.array(
        F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )
    return internal(edges).select("repo_id", F.explode(ends).alias("e")).groupBy("repo_id", F.col("e.path").alias("path")).agg(
        F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound")
    )


def hub_files(edges: DataFrame, threshold: int = signals.HUB_THRESHOLD) -> DataFrame:
    return internal(edges).groupBy("repo_id", F.col("dst").alias("path")).agg(F.count("*").alias("inbound")).filter(F.col("inbound") >= threshold)


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Source files nobody imports, with an export or a default export."""
    has_export = symbols.filter((F.size("exports") > 0) | F.col("has_default_export")).select("repo_id", "path")
    imported = internal(edges).select("repo_id", F.col("dst").alias("path"))
    return has_export.join(imported, ["repo_id", "path"], "left_anti")


def leaf_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Source files that import nothing internal."""
    importing = internal(edges).select("repo_id", F.col("src").alias("path"))
    return symbols.select("repo_id", "path").join(importing, ["repo_id", "path"], "left_anti")


def key_modules(hubs: DataFrame, cat: DataFrame, symbols: DataFrame, top: int | None = 15) -> DataFrame:
    """The first ``top`` hubs of a repository (by path; None: all) with their first three exports."""
    kept = top_k_per_group(hubs, ["repo_id"], [F.asc("path")], top, "module_rank")
    types = cat.select("repo_id", "path", "extraction_type")
    exports = symbols.select("repo_id", "path", F.array_join(F.slice("exports", 1, 3), ", ").alias("exports"))
    joined = kept.join(types, ["repo_id", "path"], "left").join(exports, ["repo_id", "path"], "left")
    purpose = (
        F.when((F.col("extraction_type") == "source") & (F.col("exports") != ""), F.col("exports"))
        .when(F.col("extraction_type") == "config", F.lit("configuration"))
        .when(F.col("extraction_type") == "schema", F.lit("data schema"))
        .otherwise(F.lit("shared module"))
    )
    return joined.select("repo_id", "path", basename(F.col("path")).alias("name"), purpose.alias("purpose"), "inbound", "module_rank")


def entry_point_type(path: Column) -> Column:
    """Role by name; the later rules win."""
    p = F.lower(path)
    return (
        F.when(p.contains("cron") | p.contains("scheduler"), F.lit("cron"))
        .when(p.contains("worker") | p.contains("queue"), F.lit("worker"))
        .when(p.contains("/cli") | p.contains("/bin"), F.lit("cli"))
        .when(p.contains("server") | p.contains("app") | p.contains("main") | p.endswith("index.ts") | p.endswith("index.js"), F.lit("server"))
        .otherwise(F.lit("module"))
    )


def top_entry_points(entries: DataFrame, top: int | None = 10) -> DataFrame:
    """The first ``top`` entry points of a repository by path (None: all), with their role."""
    ranked = top_k_per_group(entries, ["repo_id"], [F.asc("path")], top, "entry_rank")
    return ranked.withColumn("entry_type", entry_point_type(F.col("path")))


def rank_sources(symbols: DataFrame, edges: DataFrame, cap: int = 200) -> DataFrame:
    """Sources with their place in a report: hubs and entry points are pinned, then the best ranked by inbound,
    outbound and path fill up to ``cap`` in total; the rest is overflow (path only).

    Only the ``cap`` best of the remainder are ranked (window group limit); overflow files need no rank.
    """
    shown = (F.size("exports") > 0) | F.col("has_default_export")
    src = symbols.select("repo_id", "path", shown.alias("_shown")).join(degree_counts(edges), ["repo_id", "path"], "left")
    zero = F.lit(0).cast("long")
    src = src.select(
        "repo_id", "path", "_shown", F.coalesce("inbound", zero).alias("inbound"), F.coalesce("outbound", zero).alias("outbound")
    )
    hub = F.col("inbound") >= signals.HUB_THRESHOLD
    entry = F.col("_shown") & (F.col("inbound") == 0)
    src = cut(src.select("repo_id", "path", "inbound", "outbound", (hub | entry).alias("pinned")))
    n_pinned = src.groupBy("repo_id").agg(F.count_if("pinned").alias("n_pinned"))
    best = top_k_per_group(
        src.filter(~F.col("pinned")), ["repo_id"], [F.desc("inbound"), F.desc("outbound"), F.asc("path")], cap, "detail_rank"
    ).select("repo_id", "path", "detail_rank")
    joined = src.join(best, ["repo_id", "path"], "left").join(n_pinned, "repo_id")
    fits = F.col("pinned") | F.coalesce(F.col("detail_rank") <= F.greatest(F.lit(cap) - F.col("n_pinned"), F.lit(0)), F.lit(False))
    return joined.select("repo_id", "path", "inbound", "outbound", "pinned", fits.alias("in_detail"))


# ---------------------------------------------------------------- cycles


def trim_acyclic(edges: DataFrame) -> DataFrame:
    """Drop edges whose source is imported by nobody or whose target imports nothing.  Such an edge is in no cycle; most
    import graphs shrink to little here.  Both ends are tested by one pass each over the (materialized) edges."""
    heads = edges.select("repo_id", F.col("dst").alias("src")).distinct()
    tails = edges.select("repo_id", F.col("src").alias("dst")).distinct()
    return edges.join(heads, ["repo_id", "src"], "left_semi").join(tails, ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst")


def import_cycles(edges: DataFrame, max_rounds: int = 10_000, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(repo_id, path, component): every file that lies on an import cycle, with the smallest path of its strongly
    connected component."""
    return cycles(edges, max_rounds, local_edges).select("repo_id", "path", "component")


def cycle_paths(edges: DataFrame, max_rounds: int = 10_000, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(repo_id, component, step, path): for each component one shortest cycle through its smallest path, from that path (step 0) on;
    the last file imports the first.  Of equally short ones, each file's predecessor is the smallest there is, from the end on."""
    return cycles(edges, max_rounds, local_edges).where("step is not null").select("repo_id", "component", "step", "path")


def cycles(edges: DataFrame, max_rounds: int = 10_000, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(repo_id, path, component, step): the files on import cycles, and the place of those on the shown cycle (else null).

    Edges that no cycle can use are trimmed.  A repository whose rest has at most ``local_edges`` edges is one bounded group and is
    solved in one pass; larger ones are coloured in rounds over the cluster, with the same result.  More than ``max_rounds`` rounds are
    an error, never a shorter answer.
    """
    live = cut(internal(edges).select("repo_id", "src", "dst").distinct())
    for _ in range(2):
        live = cut(trim_acyclic(live))
    sizes = live.groupBy("repo_id").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > local_edges).select("repo_id"))
    if large.isEmpty():
        return _local_cycles(live)
    small = _local_cycles(live.join(large, "repo_id", "left_anti"))
    return small.unionByName(_wide_cycles(cut(live.join(large, "repo_id", "left_semi")), max_rounds))


def _local_cycles(live: DataFrame) -> DataFrame:
    """Components and shown cycles of graphs that fit in a task, each within its repository."""

    def components(after: dict[str, list[str]]) -> list[list[str]]:
        """Strongly connected components, by one depth-first walk with an explicit stack."""
        index: dict[str, int] = {}
        low: dict[str, int] = {}
        open_nodes: list[str] = []
        waiting: set[str] = set()
        found = []
        for root in after:
            if root in index:
                continue
            walk = [(root, iter(after[root]))]
            index[root] = low[root] = len(index)
            open_nodes.append(root)
            waiting.add(root)
            while walk:
                node, rest = walk[-1]
                for other in rest:
                    if other not in index:
                        index[other] = low[other] = len(index)
                        open_nodes.append(other)
                        waiting.add(other)
                        walk.append((other, iter(after[other])))
                        break
                    if other in waiting:
                        low[node] = min(low[node], index[other])
                else:
                    walk.pop()
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                    if low[node] == index[node]:
                        group = []
                        while not group or group[-1] != node:
                            group.append(open_nodes.pop())
                        waiting.difference_update(group)
                        found.append(group)
        return found

    def shown(root: str, members: set[str], after: dict[str, list[str]]) -> list[str]:
        """The shortest way from ``root`` back to it; levels are visited in order, so the first parent is the smallest."""
        parent, level = {}, [root]
        while level:
            closing = min((node for node in level if root in after[node]), default=None)
            if closing is not None:
                way = [closing]
                while way[-1] != root:
                    way.append(parent[way[-1]])
                return way[::-1]
            coming = []
            for node in sorted(level):
                for other in after[node]:
                    if other in members and other not in parent and other != root:
                        parent[other] = node
                        coming.append(other)
            level = coming
        return []

    def solve(edges: list[tuple[str, str]]) -> Iterator[tuple[str, str, int | None]]:
        after: dict[str, list[str]] = {}
        for src, dst in edges:
            after.setdefault(src, []).append(dst)
            after.setdefault(dst, [])
        for nodes in components(after):
            if len(nodes) > 1 or nodes[0] in after[nodes[0]]:
                root = min(nodes, key=str.encode)
                step = {path: i for i, path in enumerate(shown(root, set(nodes), after))}
                yield from ((path, root, step.get(path)) for path in nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repositories lie one after another; the edges of one are kept until the next begins."""
        types = (pa.string(), pa.string(), pa.string(), pa.int32())
        repo, edges, rows = None, [], []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["repo_id", "path", "component", "step"])
            rows.clear()
            return made

        for part in batches:
            for of, src, dst in zip(*(part.column(n).to_pylist() for n in ("repo_id", "src", "dst"))):
                if of != repo:
                    rows += [(repo, *row) for row in solve(edges)]
                    repo, edges = of, []
                    if len(rows) >= ROWS_PER_BATCH:
                        yield batch()
                edges.append((src, dst))
        rows += [(repo, *row) for row in solve(edges)]
        if rows:
            yield batch()

    lying = live.select("repo_id", "src", "dst").repartition("repo_id").sortWithinPartitions("repo_id")
    return lying.mapInArrow(run, "repo_id string, path string, component string, step int")


def _wide_cycles(live: DataFrame, max_rounds: int) -> DataFrame:
    """Components of any size.  Forward colouring: each round gives every node the smallest node known to reach it (a join on edges, a
    combinable minimum, and a jump to the colour of its colour, which reaches it as well).  Nodes that reach their own colour back inside
    the colour form that colour's component; they leave the graph and the rest goes on.  State is one row per node, never per pair."""
    start = live
    parts: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        nodes = live.select("repo_id", F.explode(F.array("src", "dst")).alias("path")).distinct()
        color = _smallest_reaching(cut(nodes.withColumn("color", F.col("path"))), live, max_rounds)
        same = (
            live.join(color.select("repo_id", F.col("path").alias("src"), F.col("color").alias("c1")), ["repo_id", "src"])
            .join(color.select("repo_id", F.col("path").alias("dst"), F.col("color").alias("c2")), ["repo_id", "dst"])
            .filter("c1 = c2").select("repo_id", "src", "dst", F.col("c1").alias("color"))
        )
        same = cut(same)
        members = _reach_back(color.filter("path = color"), same, max_rounds)
        # a root without an edge to itself and without a partner is no cycle
        sizes = members.groupBy("repo_id", "color").agg(F.count("*").alias("n"))
        loops = live.filter("src = dst").select("repo_id", F.col("src").alias("path"), F.lit(True).alias("loop"))
        cyclic = members.join(sizes, ["repo_id", "color"]).join(loops, ["repo_id", "path"], "left").filter("n > 1 or loop")
        parts.append(cut(cyclic.select("repo_id", "path", F.col("color").alias("component"))))
        done = members.select("repo_id", "path")
        rest = live.join(done.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_anti")
        rest = rest.join(done.withColumnRenamed("path", "dst"), ["repo_id", "dst"], "left_anti")
        live = cut(trim_acyclic(cut(rest.select("repo_id", "src", "dst"))))
    else:
        if not live.isEmpty():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not parts:
        return start.select("repo_id", F.col("src").alias("path"), F.col("src").alias("component"), F.lit(None).cast("int").alias("step")).limit(0)
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    steps = _wide_paths(cut(members), start, max_rounds)
    return members.join(steps, ["repo_id", "component", "path"], "left").select("repo_id", "path", "component", "step")


def _wide_paths(members: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """(repo_id, component, path, step) of the shown cycles: levels from the smallest member on, each node with its smallest parent, then
    back along the parents.  As many rounds as the longest shown cycle has files."""
    key = ["repo_id", "component"]
    inner = cut(
        edges.join(members.withColumnRenamed("path", "src"), ["repo_id", "src"])
        .join(members.select("repo_id", F.col("path").alias("dst"), F.col("component").alias("_other")), ["repo_id", "dst"])
        .where("component = _other").select(*key, "src", "dst")
    )
    level = cut(members.where("path = component").select(*key, "path"))
    seen = cut(level.withColumn("parent", F.lit(None).cast("string")))
    ends: list[DataFrame] = []
    for depth in range(max_rounds):
        if level.isEmpty():
            break
        out = cut(inner.join(level.withColumnRenamed("path", "src"), [*key, "src"]))
        closed = cut(out.where("dst = component").groupBy(*key).agg(F.min("src").alias("path")).withColumn("step", F.lit(depth)))
        ends.append(closed)
        coming = out.join(closed.select(*key), key, "left_anti").groupBy(*key, F.col("dst").alias("path")).agg(F.min("src").alias("parent"))
        fresh = cut(coming.join(seen.select(*key, "path"), [*key, "path"], "left_anti").select(*key, "path", "parent"))
        seen = cut(seen.unionByName(fresh))
        level = fresh.select(*key, "path")
    else:
        if not level.isEmpty():
            raise RuntimeError(f"cycles are longer than {max_rounds} files")
    at = ends[0]
    for e in ends[1:]:
        at = at.unionByName(e)
    at = cut(at)
    way = at
    for _ in range(len(ends)):
        at = cut(at.join(seen, [*key, "path"]).where("parent is not null").select(*key, F.col("parent").alias("path"), (F.col("step") - 1).alias("step")))
        if at.isEmpty():
            break
        way = cut(way.unionByName(at))
    return way


def _smallest_reaching(color: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """Smallest node that reaches each node."""
    for _ in range(max_rounds):
        pushed = edges.join(color.withColumnRenamed("path", "src"), ["repo_id", "src"]).select(
            "repo_id", F.col("dst").alias("path"), "color", F.lit(None).cast("string").alias("old")
        )
        # whatever reaches a node's colour reaches the node
        further = color.select("repo_id", F.col("path").alias("color"), F.col("color").alias("far"))
        jumped = color.join(further, ["repo_id", "color"]).select("repo_id", "path", F.col("far").alias("color"), F.lit(None).cast("string").alias("old"))
        merged = color.select("repo_id", "path", "color", F.col("color").alias("old")).unionByName(pushed).unionByName(jumped)
        step = cut(merged.groupBy("repo_id", "path").agg(F.min("color").alias("color"), F.min("old").alias("old")))
        color = step.select("repo_id", "path", "color")
        if step.filter("color < old").isEmpty():
            return color
    raise RuntimeError("colouring did not settle")


def _reach_back(roots: DataFrame, same: DataFrame, max_rounds: int) -> DataFrame:
    """Nodes that reach the root of their colour over edges inside the colour, roots included."""
    seen = cut(roots.select("repo_id", "color", "path"))
    frontier = seen
    for _ in range(max_rounds):
        nxt = same.join(frontier.withColumnRenamed("path", "dst"), ["repo_id", "color", "dst"]).select("repo_id", "color", F.col("src").alias("path")).distinct()
        nxt = cut(nxt.join(seen, ["repo_id", "color", "path"], "left_anti"))
        if nxt.isEmpty():
            return seen
        seen = cut(seen.unionByName(nxt))
        frontier = nxt
    raise RuntimeError("reachability did not settle")
