"""Oracle SQL of ``bindings.q_files``."""

from __future__ import annotations

from bindings.oracles.common import CORPUS, REPO, lit, slist, strings, values, with_
from bindings.templates import SYMLINK_PATHS
from factloom import signals as s
from factloom.functions.regex import WS_CHARS, to_re2

NAME = "regexp_extract(path, '([^/]*)$', 1)"
RAW_EXT = f"regexp_extract({NAME}, '(?s:.)(\\.[^.]*)$', 1)"
EXT = f"lower({RAW_EXT})"
WS = lit(WS_CHARS)


def case_map(expr: str, mapping: dict[str, str]) -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END)"


def rx(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {lit(to_re2(pattern, flags))})"


def has_any(expr: str, items) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(i)})" for i in items) + ")"


DIRS = "string_split(path, '/')[1:-2]"
EXCLUDED = (
    f"len(list_filter({DIRS}, lambda d: d IN {strings(s.EXCLUDED_DIRS)} OR (starts_with(d, '.') AND d NOT IN {strings(s.KEPT_DOT_DIRS)}))) > 0"
)
LANG = case_map(EXT, s.LANGUAGE_OF_EXTENSION)
SYMLINK = f"(path IN {strings(SYMLINK_PATHS)})"
HEAD10 = "array_to_string(string_split(content, chr(10))[1:10], chr(10))"
CLASS = f"""CASE WHEN {NAME} IN {strings(s.LOCKFILE_FORMATS)} THEN 'lockfile'
  WHEN regexp_matches({NAME}, '^\\.env(\\.|$)') THEN 'env'
  WHEN {EXT} IN {strings(s.BINARY_EXTENSIONS)} THEN 'binary'
  WHEN {EXT} IN {strings(s.DATA_EXTENSIONS)} THEN 'data'
  WHEN {EXT} IN {strings(s.SCHEMA_EXTENSIONS)} OR regexp_matches(lower({NAME}), '^(schema|models|types)\\.')
    OR list_has_any(string_split(path, '/'), {slist(s.SCHEMA_DIRS)}) THEN 'schema'
  WHEN {EXT} IN {strings(s.DOC_EXTENSIONS)} THEN 'docs'
  WHEN {EXT} IN ('.sh', '.bash') OR {NAME} IN ('Makefile', 'Dockerfile') THEN 'script'
  WHEN {EXT} IN {strings(s.SOURCE_EXTENSIONS)} OR coalesce({LANG} NOT IN ('JSON', 'YAML', 'TOML'), false) THEN 'source'
  WHEN {EXT} IN {strings(s.CONFIG_EXTENSIONS)} THEN 'config'
  WHEN strlen(content) > 1000000 THEN 'data' ELSE 'source' END"""
BINARY = "(length(left(content, 8000)) - length(replace(left(content, 8000), chr(0), ''))) > 0.01 * length(left(content, 8000))"
GENERATED = (
    f"(list_has_any(string_split(path, '/'), {slist(s.GENERATED_DIRS)}) OR path LIKE '%.d.ts' OR (base = 'source' AND {has_any('head', s.GENERATED_MARKERS)}))"
)


def catalog(source: str):
    return (
        "cat",
        f"""SELECT *, CASE WHEN is_symlink THEN 'unknown' WHEN base = 'binary' THEN base
  WHEN base IN ('lockfile', 'env') THEN CASE WHEN is_bin THEN 'error' ELSE base END
  WHEN is_bin THEN 'binary' WHEN base = 'data' OR size_bytes > 1000000 THEN 'data' WHEN {GENERATED} THEN 'generated' ELSE base END AS extraction_type
FROM (SELECT repo_id, path, {NAME} AS name, {EXT} AS ext, strlen(content)::BIGINT AS size_bytes, CASE WHEN {SYMLINK} THEN NULL ELSE {LANG} END AS language,
  {SYMLINK} AS is_symlink, content, {CLASS} AS base, {HEAD10} AS head, {BINARY} AS is_bin FROM {source} WHERE NOT ({EXCLUDED}))""",
    )


CAT = catalog("corpus_files")
RCAT = catalog("repo_files")
KEPT = ("kept", f"SELECT * FROM repo_files WHERE NOT ({EXCLUDED})")
IS_TEST = "(" + " OR ".join(rx(NAME, r) for r in s.TEST_NAME_REGEXES) + " OR " + has_any("path", s.TEST_PATH_FRAGMENTS) + ")"
IS_SCHEMA = (
    f"({NAME} IN ('schema.prisma', 'schema.sql', 'schema.rb', 'db.ts', 'db.js') OR ({NAME} LIKE '%.sql' AND contains(path, 'schema')) "
    f"OR (contains(path, 'prisma/') AND {NAME} LIKE '%.prisma'))"
)
MIGRATION_HITS = (
    f"(CASE WHEN regexp_matches({NAME}, '\\.(sql|ts|js|py|rb)$') THEN "
    + " + ".join(f"contains(path, {lit(d)})::INTEGER" for d in s.MIGRATION_DIRS) + " ELSE 0 END)"
)

# ---- data files
HEAD50 = "array_to_string(l[1:50], chr(10))"
FORMAT = f"""CASE WHEN ext = '.log' OR regexp_matches(head, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}') THEN 'log'
  WHEN ext = '.csv' THEN 'csv' WHEN ext = '.tsv' THEN 'tsv' WHEN ext IN ('.jsonl', '.ndjson') THEN 'ndjson'
  WHEN ext = '.sql' OR contains(head, 'INSERT INTO') OR contains(head, 'CREATE TABLE') THEN 'sql-dump' WHEN ext = '.xml' THEN 'xml'
  WHEN left(trim(head, {WS}), 1) IN ('{{', '[') THEN 'json-data' WHEN ext IN ('.dump', '.bak', '.backup') THEN 'backup'
  WHEN ext IN ('.db', '.sqlite', '.sqlite3') THEN 'sqlite' ELSE 'unknown' END"""

# ---- symbols, on exploded lines
R = s.SYMBOL_REGEXES
LINES = (
    "src_lines",
    f"""SELECT repo_id, path, language, i, raw, trim(raw, {WS}) AS t FROM (
  SELECT repo_id, path, language, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS i
  FROM cat WHERE extraction_type = 'source')""",
)
GO_STATE = (
    "go_lines",
    """SELECT *, coalesce(last_value(CASE WHEN t = 'import (' THEN 1 WHEN t = ')' THEN 0 END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY i), 0) = 1 AS in_block
FROM src_lines WHERE language = 'Go'""",
)


def _ex(pattern: str, group: int = 1, col: str = "t") -> str:
    return f"regexp_extract({col}, {lit(to_re2(pattern))}, {group})"


def _sym(kind: str, j: int, expr: str, where: str, source: str = "src_lines") -> str:
    return f"SELECT repo_id, path, '{kind}' AS kind, i, {j} AS j, 0 AS k, {expr} AS v FROM {source} WHERE {where}"


TSJS, PY, JVM, RB = "language IN ('TypeScript', 'JavaScript')", "language = 'Python'", "language IN ('Java', 'Kotlin')", "language = 'Ruby'"
_GO_OUT = "NOT in_block AND t <> 'import ('"
SYMS = (
    "syms",
    "SELECT * FROM (" + " UNION ALL ".join([
        _sym("exports", 0, _ex(R["script"]["exports"]), TSJS),
        _sym("imports", 0, _ex(R["script"]["import_from"]), TSJS),
        f"SELECT repo_id, path, 'imports', i, 1, k, v FROM (SELECT repo_id, path, i, unnest(h) AS v, generate_subscripts(h, 1) AS k FROM (SELECT *, regexp_extract_all(t, {lit(to_re2(R['script']['require']))}, 1) h FROM src_lines WHERE {TSJS}))",
        _sym("functions", 0, _ex(R["script"]["function"]), TSJS), _sym("functions", 1, _ex(R["script"]["arrow"]), TSJS),
        _sym("classes", 0, _ex(R["script"]["class"]), TSJS), _sym("decorators", 0, _ex(R["decorator"]), f"({TSJS} OR {PY} OR {JVM})"),
        _sym("exports", 0, _ex(R["python"]["function"]), f"{PY} AND NOT starts_with({_ex(R['python']['function'])}, '_')"),
        _sym("exports", 1, _ex(R["python"]["class"]), f"{PY} AND NOT starts_with({_ex(R['python']['class'])}, '_')"),
        _sym("imports", 0, _ex(R["python"]["import"], 1), PY), _sym("imports", 1, _ex(R["python"]["import"], 2), PY),
        _sym("functions", 0, _ex(R["python"]["function"]), PY), _sym("classes", 0, _ex(R["python"]["class"]), PY),
        _sym("imports", 0, _ex(R["go"]["block_import"], 1, "raw"), "in_block", "go_lines"),
        _sym("imports", 0, _ex(R["go"]["import"]), _GO_OUT, "go_lines"),
        _sym("functions", 0, _ex(R["go"]["function"]), _GO_OUT, "go_lines"), _sym("classes", 0, _ex(R["go"]["type"]), _GO_OUT, "go_lines"),
        _sym("exports", 0, _ex(R["go"]["function"]), f"{_GO_OUT} AND regexp_matches({_ex(R['go']['function'])}, '^[A-Z]')", "go_lines"),
        _sym("exports", 1, _ex(R["go"]["type"]), f"{_GO_OUT} AND regexp_matches({_ex(R['go']['type'])}, '^[A-Z]')", "go_lines"),
        _sym("classes", 0, _ex(R["jvm"]["class"]), JVM), _sym("exports", 0, _ex(R["jvm"]["class"]), JVM),
        _sym("functions", 0, _ex(R["jvm"]["method"]), JVM), _sym("imports", 0, f"regexp_replace({_ex(R['jvm']['import'])}, ';', '')", JVM),
        _sym("functions", 0, _ex(R["ruby"]["function"]), RB), _sym("classes", 0, _ex(R["ruby"]["class"]), RB),
        _sym("imports", 0, _ex(R["ruby"]["import"]), RB),
    ]) + ") WHERE v <> ''",
)
SYM_FIRST = (
    "sym_first",
    "SELECT repo_id, path, kind, v, min({'i': i, 'j': j, 'k': k}) AS o FROM syms GROUP BY ALL",
)


def _agg(kind: str) -> str:
    return f"coalesce(string_agg(v, ',' ORDER BY o) FILTER (kind = '{kind}'), '') AS {kind}"


SYMBOLS_SELECT = (
    f"""SELECT c.repo_id, c.path, {', '.join(_agg(k) for k in ('exports', 'imports', 'functions', 'classes', 'decorators'))},
  coalesce(bool_or(d.path IS NOT NULL), false) AS has_default_export
FROM cat c LEFT JOIN sym_first f USING (repo_id, path)
LEFT JOIN (SELECT DISTINCT repo_id, path FROM src_lines WHERE {TSJS} AND {rx('t', R['script']['default'])}) d USING (repo_id, path)
WHERE c.extraction_type = 'source' GROUP BY c.repo_id, c.path"""
)
SYMBOLS = (*REPO, RCAT, LINES, GO_STATE, SYMS, SYM_FIRST)

# ---- environment
ENV_FILE = f"({NAME} LIKE '.env%' OR {NAME} LIKE '%.env')"
SECRET = f"regexp_matches(name, {lit('(?i)' + '|'.join(s.ENV_SECRET_WORDS))})"
PURPOSE = "CASE " + " ".join(f"WHEN {rx('name', p, 'i')} THEN {lit(v)}" for p, v in s.ENV_PURPOSES) + " END"
_DEF = lit(to_re2(r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"))
ENV_DEFS = (
    "env_defs",
    f"""SELECT repo_id, name, path, line_no, has_value, is_template, {PURPOSE} AS purpose, {SECRET} AS is_secret FROM (
  SELECT repo_id, path, line_no, regexp_extract(t, {_DEF}, 1) AS name, trim(regexp_extract(t, {_DEF}, 2), {WS}) <> '' AS has_value,
    regexp_matches(path, '\\.(example|template|sample|dist)$') AS is_template
  FROM (SELECT repo_id, path, trim(unnest(string_split(content, chr(10))), {WS}) AS t, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no
        FROM kept WHERE {ENV_FILE} AND path NOT IN ('latest'))
  WHERE NOT starts_with(t, '#') AND regexp_matches(t, {_DEF}))""",
)
ENV_REFS = (
    "env_refs",
    f"""SELECT repo_id, name, path, ref_no::INTEGER AS ref_no, {PURPOSE} AS purpose, {SECRET} AS is_secret FROM (
  SELECT repo_id, path, unnest(n) AS name, generate_subscripts(n, 1) AS ref_no FROM (
    SELECT repo_id, path, flatten([{', '.join(f"regexp_extract_all(content, {lit(to_re2(r))}, 1)" for r in s.ENV_REFERENCE_REGEXES)}]) AS n
    FROM kept WHERE {RAW_EXT} IN {strings(s.ENV_SOURCE_EXTENSIONS)} AND NOT {has_any('path', ('node_modules', '.test.', '.spec.'))}))""",
)
ENV_ALL = (
    "env_all",
    """SELECT repo_id, name, path, pos, has_value, is_template, purpose, is_secret, rank FROM (
  SELECT repo_id, name, path, line_no AS pos, has_value, is_template, purpose, is_secret, 0 AS rank FROM env_defs
  UNION ALL SELECT repo_id, name, path, ref_no, false, false, purpose, is_secret, 1 FROM env_refs)
QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY rank, path, pos) = 1""",
)
ENV = (*REPO, KEPT, ENV_DEFS, ENV_REFS, ENV_ALL)

# ---- manifests
M = s.MANIFEST_REGEXES


def _lines_of(name: str) -> str:
    return (
        f"SELECT repo_id, path, trim(unnest(string_split(content, chr(10))), {WS}) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i "
        f"FROM kept WHERE {NAME} = '{name}'"
    )


def _hits_of(names: str, pattern: str, flags: str = "") -> str:
    h = f"regexp_extract_all(content, {lit(to_re2(pattern, flags))}, 0)"
    return f"SELECT repo_id, path, unnest({h}) AS m, generate_subscripts({h}, 1) AS i FROM kept WHERE {NAME} IN {names}"


def _json_part(name: str, key: str, dev: str, ord_: int) -> str:
    return f"""SELECT repo_id, path AS file, '{name}' AS manifest_type, content->>'$.name' AS manifest_name,
  {"content->>'$.version'" if name == 'package.json' else 'NULL'} AS manifest_version, {ord_} AS part, i, k AS dep,
  json_extract_string(content, '$."{key}"."' || k || '"') AS dep_version, {dev} AS is_dev
FROM (SELECT *, unnest(json_keys(content, '$."{key}"')) AS k, generate_subscripts(json_keys(content, '$."{key}"'), 1) AS i
      FROM kept WHERE {NAME} = '{name}' AND json_valid(content))"""


_G = lit(to_re2(M["gradle"]))
_POM_DEPS = "regexp_extract_all(content, '(?s)<dependency>(.*?)</dependency>', 1)"
DEPS_RAW = (
    "deps_raw",
    " UNION ALL ".join([
        _json_part("package.json", "dependencies", "false", 0), _json_part("package.json", "devDependencies", "true", 1),
        _json_part("composer.json", "require", "false", 0), _json_part("composer.json", "require-dev", "true", 1),
        f"""SELECT repo_id, path, 'requirements.txt', NULL, NULL, 0, i, lower(regexp_extract(t, {lit(to_re2(M['requirement']))}, 1)),
  coalesce(nullif(trim(regexp_extract(t, {lit(to_re2(M['requirement']))}, 2), {WS}), ''), '*'), false
FROM ({_lines_of('requirements.txt')}) WHERE NOT starts_with(t, '-') AND {rx('t', M['requirement'])}""",
        f"""SELECT l.repo_id, l.path, 'go.mod', mod.name, NULL, 0, i, regexp_extract(t, {lit(to_re2(M['go_require']))}, 1), regexp_extract(t, {lit(to_re2(M['go_require']))}, 2), false
FROM ({_lines_of('go.mod')}) l LEFT JOIN (SELECT repo_id, path, arg_max(regexp_extract(t, {lit(to_re2(M['go_module']))}, 1), i) AS name FROM ({_lines_of('go.mod')})
  WHERE {rx('t', M['go_module'])} GROUP BY ALL) mod USING (repo_id, path) WHERE NOT {rx('t', M['go_module'])} AND {rx('t', M['go_require'])}""",
        f"""SELECT repo_id, path, 'build.gradle', NULL, NULL, 0, i, array_to_string(string_split(regexp_extract(m, {_G}, 1), ':')[1:2], ':'),
  coalesce(string_split(regexp_extract(m, {_G}, 1), ':')[3], '*'), starts_with(m, 'test') FROM ({_hits_of("('build.gradle', 'build.gradle.kts')", M['gradle'])})""",
        f"""SELECT repo_id, path, 'Gemfile', NULL, NULL, 0, i, regexp_extract(m, {lit(to_re2(M['gem']))}, 1), coalesce(nullif(regexp_extract(m, {lit(to_re2(M['gem']))}, 2), ''), '*'), false
FROM ({_hits_of("('Gemfile')", M['gem'], 'm')})""",
        f"""SELECT repo_id, path, 'pom.xml', regexp_extract(content, '<project><artifactId>([^<]*)', 1), regexp_extract(content, '</artifactId><version>([^<]*)</version><dependencies>', 1), 0, i,
  regexp_extract(d, '<groupId>([^<]*)', 1) || ':' || regexp_extract(d, '<artifactId>([^<]*)', 1), coalesce(nullif(regexp_extract(d, '<version>([^<]*)', 1), ''), '*'), contains(d, '<scope>test<')
FROM (SELECT *, unnest({_POM_DEPS}) AS d, generate_subscripts({_POM_DEPS}, 1) AS i FROM kept WHERE {NAME} = 'pom.xml')""",
    ]),
)
DEPS_NATIVE = (
    "deps_native",
    "SELECT repo_id, file, manifest_type, manifest_name, manifest_version, (row_number() OVER (PARTITION BY repo_id, file ORDER BY part, i))::INTEGER AS dep_pos, dep, dep_version, is_dev FROM deps_raw",
)
# TOML has no SQL reader: these lines follow the derived files' layout
DEPS_TOML = (
    "deps_toml",
    f"""SELECT c.repo_id, c.path AS file, {NAME} AS manifest_type, n AS manifest_name, v AS manifest_version, d.dep_pos, d.dep, coalesce(d.dep_version, d.prefix || c_nat, '*') AS dep_version, d.is_dev
FROM (SELECT *, regexp_extract(content, 'name = "([^"]*)"', 1) AS n, regexp_extract(content, 'version = "([^"]*)"', 1) AS v, '' AS c_nat FROM kept WHERE {NAME} IN ('Cargo.toml', 'pyproject.toml')) c
JOIN (VALUES ('crate', 1, 'serde', '1', NULL, false), ('crate', 2, 'sqlx-postgres', '0.7', NULL, false), ('crate', 3, 'local', '*', NULL, false), ('crate', 4, 'proptest', '1', NULL, true),
  ('svc', 1, 'flask', '>=2', NULL, false), ('svc', 2, 'alembic', '*', NULL, false), ('svc', 3, 'celery', '[redis]', NULL, false),
  ('poet', 1, 'django', '^5.0', NULL, false), ('poet', 2, 'tortoise-orm', '0.20', NULL, false), ('poet', 3, 'pytest', '^8', NULL, true))
  d(kind, dep_pos, dep, dep_version, prefix, is_dev) ON starts_with(c.n, d.kind || '-')""",
)
DEPS = ("deps", "SELECT * FROM deps_native UNION ALL SELECT * FROM deps_toml")
ALL_DEPS = (*REPO, KEPT, DEPS_RAW, DEPS_NATIVE, DEPS_TOML, DEPS)

# ---- infrastructure
WORKFLOWS = (
    "workflows",
    f"""SELECT repo_id, path, coalesce(nullif(regexp_extract(content, '(?m)^name: (.*)$', 1), ''), regexp_replace({NAME}, '\\.ya?ml$', '')) AS workflow,
  CASE WHEN contains(content, 'on: [') THEN 'push,pull_request' WHEN contains(content, 'on: push') THEN 'push' ELSE 'push,workflow_dispatch' END AS triggers,
  array_to_string(regexp_extract_all(regexp_extract(content, '(?s)jobs:.*$'), '(?m)^  (\\S+):', 1), ',') AS jobs
FROM kept WHERE contains(path, '.github/workflows/') AND regexp_matches(path, '\\.ya?ml$') AND content <> ''""",
)
PORTS = f"""SELECT DISTINCT repo_id, port FROM (
  SELECT repo_id, unnest(regexp_extract_all(content, {lit(to_re2(r'^EXPOSE\s+(\d+)', 'm'))}, 1))::INTEGER AS port FROM kept WHERE {NAME} = 'Dockerfile' OR {NAME} LIKE 'Dockerfile.%'
  UNION ALL SELECT repo_id, unnest(regexp_extract_all(content, {lit(to_re2('["' + chr(39) + r']?(\d+):(\d+)["' + chr(39) + ']?'))}, 1))::INTEGER FROM kept WHERE {NAME} LIKE 'docker-compose%' OR contains(path, '/compose/')) WHERE port > 0"""
TARGETS = f"""SELECT repo_id, path, (row_number() OVER (PARTITION BY repo_id ORDER BY i))::INTEGER AS target_no, target FROM (
  SELECT repo_id, path, target, min(i) AS i FROM (SELECT repo_id, path, unnest(h) AS target, generate_subscripts(h, 1) AS i FROM (
    SELECT *, regexp_extract_all(content, {lit(to_re2(r'^([a-zA-Z0-9_-]+)\s*:', 'm'))}, 1) h FROM kept WHERE {NAME} = 'Makefile'
    QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) = 1)) GROUP BY ALL)"""
PACKAGES = (
    "packages",
    f"""SELECT repo_id, regexp_replace(path, '/[^/]*$', '') AS package_path, path AS manifest_path,
  CASE WHEN {NAME} = 'package.json' AND json_valid(content) AND json_type(content, '$.name') = 'VARCHAR' THEN nullif(content->>'$.name', '') END AS package_name
FROM kept WHERE {NAME} IN {strings(s.WORKSPACE_MANIFESTS)} AND contains(path, '/')""",
)

ORACLES = {
    "file_catalog": with_(*CORPUS, CAT, select="SELECT repo_id, path, name, ext, size_bytes, language, is_symlink, extraction_type FROM cat"),
    "drop_excluded_paths": with_(*CORPUS, select=f"SELECT repo_id, count(*) AS files FROM corpus_files WHERE NOT ({EXCLUDED}) GROUP BY repo_id"),
    "normalize_path": "SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name AS path FROM part",
    "repo_name_from_remote": "SELECT c_custkey, 'app-' || c_custkey AS repo_name FROM customer",
    "language_of": with_(*CORPUS, select=f"SELECT repo_id, path, {LANG} AS language, coalesce({LANG} IN {strings(s.SOURCE_LANGUAGES)}, false) AS is_source FROM corpus_files WHERE NOT {SYMLINK}"),
    "key_directories": with_(
        *CORPUS,
        select=f"""SELECT DISTINCT repo_id, array_to_string(d[1:i], '/') AS path, {case_map('d[i]', s.ROLE_OF_DIRECTORY)} AS role
FROM (SELECT repo_id, {DIRS} AS d, unnest(range(1, len({DIRS}) + 1)) AS i FROM corpus_files WHERE NOT ({EXCLUDED})) WHERE role IS NOT NULL""",
    ),
    "directory_listing": with_(
        *CORPUS,
        select=f"""SELECT DISTINCT repo_id, array_to_string(p[1:i-1], '/') AS directory, p[i] AS name, i < len(p) AS is_directory, (CASE WHEN i < len(p) THEN '0' ELSE '1' END) || p[i] AS sort_key
FROM (SELECT repo_id, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM corpus_files WHERE NOT ({EXCLUDED}))""",
    ),
    "classify_file": with_(*CORPUS, select=f"SELECT repo_id, path, {CLASS} AS file_class FROM corpus_files"),
    "refine_extraction_type": with_(
        *CORPUS, CAT,
        select="""SELECT repo_id, path, extraction_type, CASE WHEN extraction_type <> 'generated' THEN NULL WHEN contains(head, 'prisma') THEN 'Prisma'
  WHEN contains(head, 'graphql-codegen') OR contains(head, 'GraphQL Code Generator') THEN 'GraphQL Codegen'
  WHEN contains(head, 'openapi-generator') OR contains(head, 'OpenAPI Generator') THEN 'OpenAPI Generator'
  WHEN contains(head, 'protoc') THEN 'Protobuf' WHEN path LIKE '%.d.ts' THEN 'TypeScript Declaration' END AS generator FROM cat""",
    ),
    "binary_format": with_(*CORPUS, CAT, select=f"SELECT repo_id, path, coalesce({case_map('ext', s.MIME_OF_EXTENSION)}, 'application/octet-stream') AS mime FROM cat WHERE extraction_type = 'binary'"),
    "characterize_data": with_(
        *CORPUS,
        select=f"""SELECT repo_id, path, {FORMAT} AS data_format, sha256(head || CASE WHEN len(l) > 70 THEN chr(10) || '...' || chr(10) || array_to_string(l[-20:], chr(10)) ELSE '' END) AS sample_hash
FROM (SELECT *, {HEAD50} AS head FROM (SELECT repo_id, path, {EXT} AS ext, string_split(content, chr(10)) AS l FROM corpus_files))""",
    ),
    "cap_content": "SELECT doc_id, least(length(text), 5000)::INTEGER AS kept_chars, least(length(text), 512000)::INTEGER AS kept_default FROM documents",
    "is_test_file": with_(*CORPUS, select=f"SELECT repo_id, path FROM corpus_files WHERE {IS_TEST}"),
    "schema_and_migration_files": with_(*CORPUS, select=f"SELECT repo_id, path, {IS_SCHEMA} AS is_schema, {MIGRATION_HITS} AS migration_hits FROM corpus_files WHERE {IS_SCHEMA} OR {MIGRATION_HITS} > 0"),
    "language_inventory": with_(
        *CORPUS, CAT,
        select=f"""SELECT repo_id, language, files, first_value(language) OVER (PARTITION BY repo_id ORDER BY files DESC, fp) AS primary_language FROM (
  SELECT repo_id, language, count(*) AS files, min(path) AS fp FROM cat WHERE language IN {strings(s.SOURCE_LANGUAGES)} GROUP BY ALL)""",
    ),
    "file_counts": with_(
        *CORPUS, CAT,
        select="""SELECT repo_id, count(*) FILTER (NOT is_symlink) AS total_files, count(*) FILTER (is_symlink) AS symlinks, count(*) FILTER (extraction_type = 'binary') AS binary_files,
  count(*) FILTER (extraction_type = 'generated') AS generated_files, count(*) FILTER (extraction_type = 'data') AS data_files, count(*) FILTER (extraction_type = 'error') AS error_files FROM cat GROUP BY repo_id""",
    ),
    "extraction_type_breakdown": with_(*CORPUS, CAT, select="SELECT repo_id, extraction_type, count(*) AS files FROM cat GROUP BY ALL"),
    "top_level_dirs": with_(*CORPUS, CAT, select="SELECT repo_id, string_split(path, '/')[1] AS top_dir, count(*) AS files FROM cat GROUP BY ALL"),
    "explode_lines": "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no, length(unnest(string_split(text, chr(10))))::INTEGER AS chars FROM documents",
    "lockfile_deps": with_(
        *REPO, RCAT,
        select=f"""SELECT repo_id, path, {case_map('name', s.LOCKFILE_FORMATS)} AS lockfile_format, (CASE WHEN v > 0 THEN v ELSE a END)::INTEGER AS dependency_count FROM (
  SELECT *, len(regexp_extract_all(content, {lit(to_re2(r'^\s+"?version"?:', 'm'))})) AS v, len(regexp_extract_all(content, '(?m)^[a-zA-Z@]')) AS a FROM cat WHERE extraction_type = 'lockfile')""",
    ),
    "source_symbols": with_(*SYMBOLS, select=SYMBOLS_SELECT),
    "env_file_keys": with_(
        *REPO, RCAT,
        select=f"""SELECT repo_id, path, array_to_string(list_filter(list_transform(list_filter(t, lambda l: l <> '' AND NOT starts_with(l, '#') AND contains(l, '=')), lambda l: trim(string_split(l, '=')[1], {WS})), lambda k: k <> ''), ',') AS keys,
  len(list_filter(l, lambda x: contains(x, '=') AND trim(substring(x, instr(x, '=') + 1), {WS}) NOT IN ('', '""', '''''') AND NOT starts_with(trim(substring(x, instr(x, '=') + 1), {WS}), '#'))) > 0 AS has_real_values
FROM (SELECT repo_id, path, string_split(content, chr(10)) AS l, list_transform(string_split(content, chr(10)), lambda x: trim(x, {WS})) AS t FROM cat WHERE extraction_type = 'env')""",
    ),
    "env_definitions": with_(*ENV, select="SELECT * FROM env_defs"),
    "env_references": with_(*ENV, select="SELECT * FROM env_refs"),
    "env_inventory": with_(*ENV, select="SELECT * FROM env_all"),
    "env_undeclared": with_(*ENV, select="SELECT DISTINCT repo_id, name FROM env_refs ANTI JOIN env_defs USING (repo_id, name)"),
    "env_required_optional": with_(*ENV, select="SELECT repo_id, name, CASE WHEN is_secret AND NOT is_template THEN 'required' ELSE 'optional' END AS need, coalesce(purpose, 'unknown') AS purpose FROM env_all"),
    "env_listing": with_(*ENV, select="SELECT repo_id, is_secret, name, name || coalesce(' — ' || purpose, '') AS label FROM env_all"),
    "manifest_dependencies": with_(*REPO, KEPT, DEPS_RAW, DEPS_NATIVE, select="SELECT * FROM deps_native"),
    "manifest_dependencies_toml": with_(*REPO, KEPT, DEPS_TOML, select="SELECT * FROM deps_toml"),
    "ci_workflows": with_(*REPO, KEPT, WORKFLOWS, select="SELECT * FROM workflows"),
    "exposed_ports": with_(*REPO, KEPT, select=PORTS),
    "make_targets": with_(*REPO, KEPT, select=TARGETS),
    "package_names": with_(*REPO, KEPT, PACKAGES, select="SELECT * FROM packages"),
}
