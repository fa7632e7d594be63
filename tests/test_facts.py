import random

import pytest
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions import paths
from factloom.operators import env, files, graph, infra, inventory, manifests, pii, routes, slices, symbols

FILES = "repo_id string, path string, content string"


def corpus(spark, rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], FILES)


def test_paths(spark):
    cases = {".env": "", "a.d.ts": ".ts", "x": "", ".env.example": ".example", "a.": "."}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert [r[0] for r in df.select(paths.extname(F.col("n"))).collect()] == list(cases.values())
    joins = [("a/b.ts", "./c", "a/c"), ("a/b.ts", "../c", "c"), ("b.ts", "./c/", "c"), ("b.ts", "../c", "../c"), ("a/b/c.ts", "../../..", "..")]
    df = spark.createDataFrame(joins, "f string, r string, want string")
    assert df.filter(paths.resolve_relative(F.col("f"), F.col("r")) != F.col("want")).count() == 0


def test_a_large_source_file_stays_source_unless_a_limit_is_given(spark):
    table = corpus(spark, [("a.ts", "export function f() {}\n" + "// x\n" * 250_000), ("LICENSE", "y" * 1_100_000)])
    of = lambda df, c: {r.path: r[c] for r in df.collect()}
    assert of(files.catalog(table), "extraction_type") == of(files.catalog(table, read=False), "file_class") == {"a.ts": "source", "LICENSE": "source"}
    assert {r.path: list(r.functions) for r in symbols.source_symbols(files.catalog(table)).collect()}["a.ts"] == ["f"]
    assert of(files.catalog(table, data_size_limit=1_000_000), "extraction_type") == {"a.ts": "data", "LICENSE": "data"}


def test_catalog_rules(spark):
    rows = {
        "node_modules/x.js": None, ".git/config": None, ".github/workflows/a.yml": "config", ".env": "env", "yarn.lock": "lockfile", "x.lock": "binary",
        "a.png": "binary", "a.csv": "data", "db/a.ts": "schema", "types.ts": "schema", "a.md": "docs", "Makefile": "script", "a.ts": "source",
        "a.json": "config", "LICENSE": "source", "gen/a.ts": "generated", "a.d.ts": "generated",
    }
    cat = files.catalog(corpus(spark, [(p, "x") for p in rows]))
    got = {r.path: r.extraction_type for r in cat.collect()}
    assert got == {p: t for p, t in rows.items() if t}


def test_binary_large_and_generated_content(spark):
    df = spark.createDataFrame(
        [("r", "bin.ts", "\0" * 30 + "a" * 500, 530, False), ("r", "big.json", "{}", 2_000_000, False), ("r", "g.ts", "\n" * 9 + "// @generated", 30, False),
         ("r", "late.ts", "\n" * 10 + "// @generated", 30, False), ("r", "link", "", 0, True), ("r", ".env", "\0\0\0", 3, False)],
        FILES + ", size_bytes long, is_symlink boolean",
    )
    got = {r.path: r.extraction_type for r in files.catalog(df, data_size_limit=signals.DATA_SIZE_LIMIT).collect()}
    assert got == {"bin.ts": "binary", "big.json": "data", "g.ts": "generated", "late.ts": "source", "link": "unknown", ".env": "error"}


def test_data_sample(spark):
    text = "\n".join(str(i) for i in range(100))
    fmt, sample = files.characterize_data(F.lit(".csv"), F.col("content"))
    row = corpus(spark, [("a.csv", text)]).select(fmt.alias("f"), sample.alias("s")).first()
    assert row.f == "csv" and row.s == "\n".join([*map(str, range(50)), "...", *map(str, range(80, 100))])


def test_symbols(spark):
    ts = "import './x';\nimport a from 'a';\nexport const f = async (x) => 1;\nexport default class K {}\nconst b = require('b'), c = require('c');\n  @Dec()\n"
    go = 'package p\nimport "one"\nimport (\n\t"two"\n\tfunc Hidden() {}\n)\nfunc (s *S) Run() {}\ntype T struct {}\n'
    cat = files.catalog(corpus(spark, [("a.ts", ts), ("b.go", go)]))
    got = {r.path: r for r in symbols.source_symbols(cat).collect()}
    a, b = got["a.ts"], got["b.go"]
    assert a.imports == ["a", "b", "c"] and a.exports == ["f", "K"] and a.functions == ["f"] and a.decorators == ["Dec"] and a.has_default_export
    assert b.imports == ["one", "two"] and b.functions == ["Run"] and b.classes == ["T"] and b.exports == ["Run", "T"]


def test_manifests(spark):
    rows = [
        ("package.json", '{"name":"my-app","version":"1.0.0","dependencies":{"express":"^4.18.0"},"devDependencies":{"typescript":"^5.0.0"}}'),
        ("bad/package.json", "{oops"), ("requirements.txt", "fastapi>=0.100.0\n# comment\nuvicorn==0.23.2\n"),
        ("Cargo.toml", '[package]\nname="c"\n[dependencies]\na = "1"\nb = {version="2"}\n'), ("bad/Cargo.toml", "= ="),
        ("pom.xml", "<project><artifactId>x</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>"),
    ]
    found = manifests.manifests(corpus(spark, rows))
    assert {r.file for r in found.collect()} == {"package.json", "requirements.txt", "Cargo.toml", "pom.xml"}
    got = [(r.file, r.dep, r.dep_version, r.is_dev) for r in manifests.dependencies(found).orderBy("file", "dep_pos").collect()]
    assert got == [
        ("Cargo.toml", "a", "1", False), ("Cargo.toml", "b", "2", False), ("package.json", "express", "^4.18.0", False), ("package.json", "typescript", "^5.0.0", True),
        ("pom.xml", "g:a", "*", False), ("requirements.txt", "fastapi", ">=0.100.0", False), ("requirements.txt", "uvicorn", "==0.23.2", False),
    ]


def test_env(spark):
    rows = [(".env", "DATABASE_URL=x\nexport JWT_SECRET=\n#A=1\n"), (".env.example", "DATABASE_URL=\nPORT=1\n"), ("a.ts", "process.env.NEW_ONE; process.env['PORT']"), ("a.test.ts", "process.env.SKIP")]
    inv = {r.name: (r.path, r.has_value, r.is_template, r.is_secret) for r in env.env_inventory(corpus(spark, rows)).collect()}
    assert inv == {"DATABASE_URL": (".env", True, False, False), "JWT_SECRET": (".env", False, False, True), "PORT": (".env.example", True, True, False), "NEW_ONE": ("a.ts", False, False, False)}
    assert [r.name for r in env.env_undeclared(corpus(spark, rows)).collect()] == ["NEW_ONE"]


def test_routes_and_gate(spark):
    rows = [
        ("package.json", '{"dependencies":{"express":"1"}}'), ("a.ts", "\n\napp.get('/x', h)\nrouter.post(\"/y\", auth, verify)\napp.get('/x', h)\n"),
        ("urls.py", "path('z')"), ("config/routes.rb", "get '/p'\nresources :o\n"),
    ]
    f = corpus(spark, rows)
    assert {r.extractor for r in routes.extract_routes(f).select("extractor").distinct().collect()} == {"node", "django", "rails"}
    deps = manifests.dependencies(manifests.manifests(f))
    got = [(r.method, r.route, r.line_no, r.auth_required) for r in routes.union_routes(f, deps, inventory.dep_frameworks(deps)).orderBy("line_no").collect()]
    assert got == [("GET", "/x", 3, True), ("POST", "/y", 4, True)]
    rails = [(r.method, r.route) for r in routes.extract_routes(f, ("rails",)).orderBy("seq").collect()]
    assert rails == [("GET", "/p"), ("GET", "/o"), ("POST", "/o"), ("GET", "/o/:id"), ("PUT", "/o/:id"), ("PATCH", "/o/:id"), ("DELETE", "/o/:id")]


def test_frameworks_and_databases(spark):
    rows = [("turbo.json", "{}"), ("schema.prisma", 'provider = "mysql"'), ("package.json", '{"dependencies":{"hono":"1","next":"1","pg":"1"}}')]
    f = corpus(spark, rows)
    found = manifests.manifests(f)
    deps = manifests.dependencies(found)
    inv = inventory.framework_inventory(f, deps, found).first()
    assert (inv.primary_framework, inv.secondary_frameworks, inv.monorepo_tool) == ("Hono", ["Next.js"], "Turborepo")
    db = inventory.database_inventory(f, deps).first()
    assert (db.engines, db.orm) == (["MySQL", "PostgreSQL"], "Prisma")


def test_phi_tables_prefix(spark):
    rows = [("schema.sql", "x"), ("schema.sql.bak.ts", "ssn"), ("other.ts", "ssn")]
    f = corpus(spark, rows)
    assert inventory.phi_tables(f, pii.pii_candidates(f)).first().phi_tables
    g = corpus(spark, rows[1:])
    assert not inventory.phi_tables(g, pii.pii_candidates(g)).first().phi_tables


def test_workflow_reader_without_yaml(monkeypatch):
    text = "name: Deploy\non:\n  push:\n    x: 1\n  pull_request:\njobs:\n  build:\n    runs-on: x\n  ship:\n"
    with_yaml = infra._read_workflow(text)
    monkeypatch.setattr(infra, "yaml", None)
    assert infra._read_workflow(text) == with_yaml == ("Deploy", ["push", "pull_request"], ["build", "ship"])


def test_import_graph(spark):
    rows = [("a.ts", "import {b} from './b';\nexport const a = 1;"), ("b.ts", "import {a} from './a';\nimport x from 'ext';\nimport y from './missing';"), ("c/index.ts", "export const c = 1;"),
            ("lib.js", "module.exports = 1;"), ("hub.ts", "export const h = 1;"), ("u.ts", "import c from './c';\nimport l from './lib.js';")]
    rows += [(f"i{n}.ts", "import h from './hub';") for n in range(5)]
    cat = files.catalog(corpus(spark, rows))
    syms = symbols.source_symbols(cat)
    none = spark.createDataFrame([], "repo_id string, package_path string, manifest_path string, package_name string")
    edges = graph.resolve_imports(symbols.raw_imports(syms), cat, none)
    got = {(r.src, r.dst, r.is_external) for r in edges.collect()}
    assert got == {("a.ts", "b.ts", False), ("b.ts", "a.ts", False), ("b.ts", "ext", True), ("u.ts", "c/index.ts", False), ("u.ts", "lib.js", False), *[(f"i{n}.ts", "hub.ts", False) for n in range(5)]}
    assert [(r.path, r.inbound) for r in graph.hub_files(edges).collect()] == [("hub.ts", 5)]
    assert {(r.path, r.component) for r in graph.import_cycles(edges).collect()} == {("a.ts", "a.ts"), ("b.ts", "a.ts")}
    assert {r.path for r in graph.leaf_files(syms, edges).collect()} == {"c/index.ts", "lib.js", "hub.ts"}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_are_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(20)}
    reach = set(pairs)
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            break
        reach |= more
    want = {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, b in reach if (b, a) in reach}
    edges = spark.createDataFrame([("r", a, b, False) for a, b in pairs], "repo_id string, src string, dst string, is_external boolean")
    assert {r.path: r.component for r in graph.import_cycles(edges).collect()} == want


def test_package_imports(spark):
    imports = spark.createDataFrame([("r", "src/a.ts", 1, "@acme/core"), ("r", "src/a.ts", 2, "@acme/core/util"), ("r", "src/a.ts", 3, "@acme/corex"), ("r", "src/a.ts", 4, "@acme/core/none")], "repo_id string, path string, import_no int, raw_import string")
    paths_ = spark.createDataFrame([("r", "packages/core/index.ts"), ("r", "packages/core/util.ts")], "repo_id string, path string")
    packages = spark.createDataFrame([("r", "packages/core", "packages/core/package.json", "@acme/core")], "repo_id string, package_path string, manifest_path string, package_name string")
    got = {r.raw_import: (r.dst, r.is_external, r.is_cross_package) for r in graph.resolve_imports(imports, paths_, packages).collect()}
    assert got == {
        "@acme/core": ("packages/core/index.ts", False, True), "@acme/core/util": ("packages/core/util.ts", False, True),
        "@acme/corex": ("@acme/corex", True, False), "@acme/core/none": ("packages/core/none", False, True),
    }


def test_slices(spark):
    df = spark.createDataFrame([("r", "src/a"), ("r", "lib/b")], "repo_id string, path string")
    assert slices.slice_rows(df, ["src/"]).count() == 1 and slices.slice_rows(df, []).count() == 2
    table = spark.createDataFrame([("r", "one", "src/"), ("r", "one", "src/a"), ("r", "two", "l")], "repo_id string, slice string, prefix string")
    assert {(r.path, r.slice) for r in slices.slice_by_prefix_table(df, table).collect()} == {("src/a", "one"), ("lib/b", "two")}


def test_plans(spark):
    from factloom.plans.facts import repository_facts, scrub_and_attest

    rows = [("package.json", '{"dependencies":{"express":"1","jsonwebtoken":"1"}}'), ("src/a.ts", "import b from './b';\napp.get('/health', h)"), ("src/b.ts", "export const ssn = 1;")]
    facts = repository_facts(corpus(spark, rows))
    assert {name: df.count() for name, df in facts.items()} == {
        "catalog": 3, "symbols": 2, "manifests": 1, "dependencies": 2, "languages": 1, "frameworks": 1, "routes": 1, "databases": 1, "env_vars": 0,
        "auth": 1, "workflows": 0, "cicd": 1, "tests": 1, "pii_candidates": 1, "phi_zones": 1, "import_edges": 1, "hub_files": 0, "entry_points": 0, "leaf_files": 1,
    }
    texts = spark.createDataFrame([(1, "a@b.org and 90210"), (2, "none")], "id long, text string")
    out = scrub_and_attest(texts, "id", "text", "me", F.lit("r"), F.lit("c"), F.lit("2024"))
    assert out.payloads.count() == 2 and out.entries.count() == 2 and out.uncertain.count() == 1
    assert out.counts.orderBy("id").first().phi_count == 2


EDGES = "repo_id string, src string, dst string, is_external boolean"


def _shown_cycle(root, pairs):
    """Shortest way from root back to it, level by level, smallest parents."""
    parent, level = {}, [root]
    while True:
        closing = [n for n in level if (n, root) in pairs]
        if closing:
            way = [min(closing)]
            while way[-1] != root:
                way.append(parent[way[-1]])
            return way[::-1]
        coming = {}
        for a, b in sorted(pairs):
            if a in level and b != root and b not in parent:
                coming.setdefault(b, a)
        parent |= coming
        level = list(coming)


@pytest.mark.parametrize("local_edges", [10**6, 0])
def test_shown_cycles_are_brute_force(spark, local_edges):
    rnd = random.Random(7)
    rows, want = [], {}
    for repo in range(6 if local_edges else 2):
        pairs = {(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for _ in range(18)}
        rows += [(f"r{repo}", a, b, False) for a, b in pairs]
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
            reach |= more
        for a in {a for a, b in reach if a == b}:
            own = {b for x, b in reach if x == a and (b, a) in reach}
            if a == min(own):
                want[f"r{repo}", a] = _shown_cycle(a, {(x, y) for x, y in pairs if x in own and y in own})
    got = {}
    for r in graph.cycle_paths(spark.createDataFrame(rows, EDGES), local_edges=local_edges).orderBy("step").collect():
        got.setdefault((r.repo_id, r.component), []).append(r.path)
        assert r.step == len(got[r.repo_id, r.component]) - 1
    assert got == want


def test_a_ring_of_a_thousand_files_takes_few_jobs(spark):
    names = [f"f{(k * 7919) % 1000:04d}" for k in range(1000)]
    rows = [("r", a, b, False) for a, b in zip(names, names[1:] + names[:1])] + [("r", "x", names[5], False), ("other", "a", "b", False)]
    edges = spark.createDataFrame(rows, EDGES)
    spark.sparkContext.setJobGroup("ring", "ring")
    try:
        way = graph.cycle_paths(edges).orderBy("step").collect()
        jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.path for r in way] == names[names.index("f0000"):] + names[: names.index("f0000")]
    assert 0 < jobs_run < 40


def test_too_few_rounds_are_an_error(spark):
    edges = spark.createDataFrame([("r", "a", "b", False), ("r", "b", "a", False)], EDGES)
    assert graph.import_cycles(edges, local_edges=0).count() == 2
    with pytest.raises(RuntimeError):
        graph.import_cycles(edges, max_rounds=0, local_edges=0)
    assert graph.import_cycles(edges.limit(0)).count() == 0


def test_top_k_without_a_limit_gives_all(spark):
    entries = spark.createDataFrame([("r", f"f{i:02d}.ts") for i in range(30)], "repo_id string, path string")
    assert graph.top_entry_points(entries).count() == 10
    assert [r.entry_rank for r in graph.top_entry_points(entries, None).orderBy("path").collect()] == list(range(1, 31))


def test_plain_references_resolve_as_their_parts_do(spark):
    import posixpath

    froms = ["a.ts", "src/a.ts", "src/x/a.ts", "/abs/a.ts", "./d/a.ts", "s//a.ts", "..hid/a.ts", "é/a.ts"]
    raws = ["./b", "b", "./b/c.js", ".", "./", "..", "../b", "../../b", "../../../b", "././b", "./b//c", "b/.", "b/..", "./..b", ".b/c.", "/b", "", "./é/b"]
    rows = [(f, r) for f in froms for r in raws]
    got = spark.createDataFrame(rows, "f string, r string").select("f", "r", paths.resolve_relative(F.col("f"), F.col("r")).alias("p")).collect()
    for row in got:
        want = posixpath.normpath((posixpath.dirname(row.f) or ".").lstrip("/") + "/" + row.r)
        assert row.p == want, tuple(row)


def test_stored_counts_give_the_same_lookup(spark):
    """Imports that are counted once meet the same packages, frequent names included."""
    imports = spark.createDataFrame([("r", f"f{i}", 1, ["@a/b/x", "lib", "./g", "@a/b"][i % 4]) for i in range(40)], "repo_id string, path string, import_no int, raw_import string")
    table = spark.createDataFrame([("r", "g.ts"), ("r", "pk/x.ts"), ("r", "pk/index.ts")], "repo_id string, path string")
    packages = spark.createDataFrame([("r", "pk", "pk/package.json", "@a/b")], "repo_id string, package_path string, manifest_path string, package_name string")
    want = {("@a/b/x", "pk/x.ts", False, True), ("lib", "lib", True, False), ("./g", "g.ts", False, False), ("@a/b", "pk/index.ts", False, True)}
    for rows_per_task in (3, 1000):
        edges = graph.resolve_imports(imports, table, packages, rows_per_task)
        assert edges.count() == 40
        assert {(r.raw_import, r.dst, r.is_external, r.is_cross_package) for r in edges.collect()} == want
