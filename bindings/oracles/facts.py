"""Oracle SQL of ``bindings.q_facts``."""

from __future__ import annotations

from bindings.oracles.common import REPO, lit, slist, strings, values, with_
from bindings.oracles.files import (
    ALL_DEPS, EXCLUDED, IS_SCHEMA, IS_TEST, KEPT, LANG, MIGRATION_HITS, NAME, PACKAGES, RAW_EXT, SYMBOLS, WORKFLOWS, case_map,
    has_any, rx,
)
from bindings.oracles.pii import IN_SCOPE, ISLANDS, LINES as HINT_LINES
from factloom import signals as s
from factloom.functions.regex import to_re2

REPOS = ("repos", "SELECT DISTINCT repo_id FROM kept")

# ---- frameworks
FW = (
    "fw",
    f"""SELECT repo_id, file, dep_pos, dep, framework FROM (SELECT *, coalesce({case_map('dep', s.FRAMEWORKS)},
  CASE {' '.join(f"WHEN contains(dep, {lit(k)}) THEN {lit(v)}" for k, v in s.FRAMEWORK_SUBSTRINGS)} END) AS framework FROM deps) WHERE framework IS NOT NULL""",
)
FW_LIST = ("fw_list", "SELECT repo_id, list(framework ORDER BY o) AS l FROM (SELECT repo_id, framework, min({'f': file, 'p': dep_pos}) AS o FROM fw GROUP BY ALL) GROUP BY repo_id")
MANIFEST_COUNT = ("pkg_count", f"SELECT repo_id, count(*) AS n FROM kept WHERE {NAME} = 'package.json' AND json_valid(content) GROUP BY repo_id")
_TOOL_RANK = "CASE " + " ".join(f"WHEN {NAME} = {lit(f)} THEN {i}" for i, (f, _) in enumerate(s.WORKSPACE_TOOLS)) + " END"
FRAMEWORKS = (
    "frameworks_inv",
    f"""SELECT r.repo_id, l[1] AS primary_framework, coalesce(array_to_string(l, ','), '') AS frameworks, coalesce(array_to_string(l[2:], ','), '') AS secondary_frameworks, tool IS NOT NULL AS is_monorepo, tool AS monorepo_tool
FROM (SELECT repo_id, {slist(t for _, t in s.WORKSPACE_TOOLS)}[min({_TOOL_RANK}) + 1] AS by_file FROM kept GROUP BY repo_id) r
LEFT JOIN fw_list USING (repo_id) LEFT JOIN pkg_count USING (repo_id), LATERAL (SELECT coalesce(by_file, CASE WHEN n > 2 THEN 'npm workspaces' END) AS tool)""",
)

# ---- databases
ENGINES = (
    "engines",
    f"""SELECT DISTINCT repo_id, engine FROM (
  SELECT repo_id, v AS engine FROM deps JOIN {values(s.DB_ENGINES.items())} e(s, v) ON contains(lower(dep), e.s)
  UNION ALL SELECT repo_id, {case_map("lower(regexp_extract(content, 'provider\\s*=\\s*[\"'']([a-zA-Z0-9_]+)[\"'']', 1))", s.PRISMA_PROVIDERS)} FROM (
    SELECT * FROM kept WHERE {NAME} = 'schema.prisma' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) = 1)) WHERE engine IS NOT NULL""",
)
ORM = (
    "orm",
    f"""SELECT r.repo_id, coalesce(d.orm, CASE WHEN p THEN 'Prisma' WHEN z THEN 'Drizzle' END) AS orm FROM (
  SELECT repo_id, bool_or({NAME} = 'schema.prisma') AS p, bool_or({NAME} IN ('drizzle.config.ts', 'drizzle.config.js')) AS z FROM kept GROUP BY repo_id) r
LEFT JOIN (SELECT repo_id, arg_min(o, {{'f': file, 'p': dep_pos}}) AS orm FROM (SELECT *, {case_map('dep', s.ORMS)} AS o FROM deps) WHERE o IS NOT NULL GROUP BY repo_id) d USING (repo_id)""",
)
TOOL = (
    "migration_tools",
    f"""SELECT r.repo_id, coalesce(d.t, CASE WHEN m THEN 'Rails ActiveRecord' WHEN a THEN 'Alembic' END) AS migration_tool FROM (
  SELECT repo_id, bool_or(contains(path, 'db/migrate/')) AS m, bool_or({NAME} = 'alembic.ini') AS a FROM kept GROUP BY repo_id) r
LEFT JOIN (SELECT repo_id, arg_min(v, i) AS t FROM deps JOIN {values((i, k, v) for i, (k, v) in enumerate(s.MIGRATION_TOOLS.items()))} e(i, s, v) ON contains(lower(dep), e.s) GROUP BY repo_id) d USING (repo_id)""",
)
CONN = (
    "conn",
    f"""SELECT DISTINCT repo_id, n AS env_name FROM kept JOIN {values((x,) for x in s.CONNECTION_ENV_NAMES)} e(n) ON contains(content, n)
WHERE {NAME} LIKE '.env%' OR {NAME} LIKE '%.env' OR ((contains({NAME}, 'database') OR contains({NAME}, 'db')) AND {RAW_EXT} IN ('.ts', '.js', '.py', '.rb'))""",
)

# ---- auth
AUTH_DEP = (
    "auth_dep",
    f"""SELECT repo_id, {slist(t for t, _ in s.AUTH_DEPENDENCIES)}[min(i) + 1] AS auth_type FROM (
  SELECT repo_id, CASE {' '.join(f"WHEN lower(dep) IN {strings(names)} THEN {i}" for i, (_, names) in enumerate(s.AUTH_DEPENDENCIES))} END AS i FROM deps)
WHERE i IS NOT NULL GROUP BY repo_id""",
)
AUTH_FILES = (
    "auth_files",
    " UNION ALL ".join(
        f"SELECT repo_id, '{t}' AS auth_type, path FROM kept WHERE {RAW_EXT} IN {strings(s.AUTH_CODE_EXTENSIONS)} AND NOT {has_any('path', ('node_modules', '.test.', '.spec.'))} AND ("
        + " OR ".join(rx("content", r, "i") for r in rxs) + ")"
        for t, rxs in s.AUTH_FILE_REGEXES
    ),
)
_GUARD = has_any("path", s.GUARD_WORDS)
AUTH = (
    "auth_inv",
    f"""SELECT a.repo_id, auth_type, source, key_files, CASE WHEN source = 'none' OR n IS NULL THEN false ELSE guarded OR all_auth END AS covers_all_routes FROM (
  SELECT d.repo_id, d.auth_type, 'dependency' AS source, count(k.path) AS key_files, coalesce(bool_or({_GUARD.replace('path', 'k.path')}), false) AS guarded
  FROM auth_dep d LEFT JOIN (SELECT repo_id, path FROM kept WHERE contains(path, 'auth') AND {RAW_EXT} IN ('.ts', '.js')) k ON k.repo_id = d.repo_id AND contains(lower(k.path), d.auth_type) GROUP BY ALL
  UNION ALL SELECT repo_id, auth_type, 'files', count(*), bool_or({_GUARD}) FROM auth_files ANTI JOIN auth_dep USING (repo_id, auth_type) GROUP BY ALL
  UNION ALL SELECT repo_id, 'unknown', 'none', 0, false FROM repos WHERE repo_id NOT IN (SELECT repo_id FROM auth_dep UNION ALL SELECT repo_id FROM auth_files)) a
LEFT JOIN (SELECT repo_id, count(*) AS n, bool_and(auth_required) AS all_auth FROM routes GROUP BY repo_id) r USING (repo_id)""",
)

# ---- tests
_TESTS = list(s.TEST_FRAMEWORKS.items())
TEST_FW = (
    "test_fw",
    f"""SELECT DISTINCT repo_id, arg_min(v, i) AS framework FROM (SELECT DISTINCT repo_id, lower(dep) AS d FROM deps) JOIN {values((i, k.lower(), v) for i, (k, v) in enumerate(_TESTS))} e(i, s, v) ON contains(d, e.s) GROUP BY repo_id, d""",
)
COVERAGE = (
    "coverage",
    f"""SELECT DISTINCT repo_id FROM (SELECT repo_id FROM deps WHERE {has_any('lower(dep)', s.COVERAGE_TOOLS)}
  UNION ALL SELECT repo_id FROM kept WHERE {NAME} = 'package.json' AND json_valid(content) AND contains(coalesce(content->>'$.scripts', ''), 'coverage'))""",
)

# ---- infrastructure
FLAGS = (
    "flags",
    f"""SELECT repo_id, bool_or({NAME} = 'Dockerfile' OR {NAME} LIKE 'Dockerfile.%') AS has_dockerfile, bool_or({NAME} LIKE 'docker-compose.%') AS has_compose,
  bool_or({has_any('path', ('k8s/', 'kubernetes/', 'manifests/'))} OR ({NAME} LIKE '%.yaml' AND {has_any(NAME, ('deployment', 'service', 'ingress'))})) AS kubernetes,
  bool_or(contains(path, 'helm/') OR {NAME} IN ('Chart.yaml', 'values.yaml')) AS helm, bool_or({NAME} = 'Makefile') AS makefile FROM kept GROUP BY repo_id""",
)
_WF = " UNION ALL ".join(
    f"SELECT repo_id, {i} AS ord, '{t}' AS target FROM workflows WHERE {has_any('lower(workflow)', ('deploy', 'release', 'publish'))} AND ({has_any('lower(workflow)', (w, *more))} OR contains(jobs, '{w}'))"
    for i, (t, w, more) in enumerate(s.WORKFLOW_TARGETS, 10)
)
_TF = " UNION ALL ".join(f"SELECT repo_id, {i}, '{t}' FROM kept WHERE {NAME} = '{f}'" for i, (f, t) in enumerate(s.TARGET_FILES, 30))
TARGETS = (
    "targets",
    f"""SELECT repo_id, target, min(ord)::INTEGER AS ord FROM (SELECT repo_id, 0 AS ord, 'Kubernetes' AS target FROM flags WHERE kubernetes UNION ALL SELECT repo_id, 1, 'Helm' FROM flags WHERE helm
  UNION ALL SELECT repo_id, 2, 'Docker' FROM flags WHERE has_dockerfile UNION ALL {_WF} UNION ALL {_TF}
  UNION ALL SELECT repo_id, 29, 'GCP App Engine' FROM kept WHERE {NAME} = 'app.yaml' AND contains(path, 'appengine')) GROUP BY repo_id, target""",
)
CICD = (
    "cicd",
    """SELECT f.*, coalesce(w.n, 0) AS workflows, coalesce(t.l, '') AS targets FROM flags f
LEFT JOIN (SELECT repo_id, count(*) AS n FROM workflows GROUP BY repo_id) w USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(target, ',' ORDER BY ord, target) AS l FROM targets GROUP BY repo_id) t USING (repo_id)""",
)
INFRA = (*REPO, KEPT, WORKFLOWS, FLAGS, TARGETS, CICD)

# ---- routes
AUTH_WORDS = "(contains({0}, 'auth') AND (contains({0}, 'middleware') OR contains({0}, 'guard') OR contains({0}, 'verify') OR contains({0}, 'authenticate')))"


def _hits(key: str, where: str, source: str = "kept") -> str:
    """Matches with text offset, line and the file's content."""
    p = lit(to_re2(*s.ROUTE_REGEXES[key]))
    return f"""SELECT repo_id, path, content, seq, m, (length(left(content, pos)) - length(replace(left(content, pos), chr(10), '')) + 1)::INTEGER AS line_no
FROM (SELECT repo_id, path, content, seq, h[seq] AS m, (list_sum(list_transform(g[1:seq], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:seq-1], lambda x: length(x))), 0))::INTEGER AS pos
  FROM (SELECT *, unnest(range(1, len(h) + 1))::INTEGER AS seq FROM (SELECT *, string_split_regex(content, {p}) AS g, regexp_extract_all(content, {p}, 0) AS h FROM {source} WHERE {where} AND regexp_matches(content, {p}))))"""


def _g(key: str, n: int) -> str:
    return f"regexp_extract(m, {lit(to_re2(*s.ROUTE_REGEXES[key]))}, {n})"


def _r(x: str, method: str, route: str, auth: str, hits: str, seq: str = "seq") -> str:
    return f"SELECT repo_id, '{x}' AS extractor, {method} AS method, {route} AS route, path, line_no, {auth} AS auth_required, ({seq})::INTEGER AS seq FROM ({hits})"


_DECL = "export[\\t\\n\\x0b\\f\\r ]+(?:async[\\t\\n\\x0b\\f\\r ]+)?function[\\t\\n\\x0b\\f\\r ]+{0}\\b"
_APP_METHODS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{_DECL.format(m)}') THEN '{m}' END" for m in s.HTTP_METHODS) + "], lambda x: x IS NOT NULL)"
_PAGES = f"""SELECT repo_id, path, content, 1 AS line_no, unnest(ms) AS method, unnest(range(0, len(ms)))::INTEGER AS seq FROM (
  SELECT *, CASE WHEN len(k) > 0 THEN k ELSE ['ALL'] END AS ms FROM (SELECT *, list_filter(list_transform(regexp_extract_all(content, {lit(to_re2(*s.ROUTE_REGEXES['pages_method']))}, 1), lambda x: upper(x)), lambda x: x IN {strings(s.HTTP_METHODS)}) AS k
    FROM kept WHERE contains(path, 'pages/api/') AND {RAW_EXT} IN ('.ts', '.js', '.tsx', '.jsx')))"""
_APP = f"""SELECT repo_id, path, content, method, seq, greatest(coalesce(list_position(list_transform(string_split(content, chr(10)), lambda l: regexp_matches(l, 'export +(?:async +)?function +' || method || '\\b')), true), 1), 1)::INTEGER AS line_no FROM (
  SELECT repo_id, path, content, unnest(ms) AS method, unnest(range(0, len(ms)))::INTEGER AS seq FROM (SELECT *, CASE WHEN len({_APP_METHODS}) > 0 THEN {_APP_METHODS} ELSE ['ALL'] END AS ms
    FROM kept WHERE contains(path, '/app/') AND {NAME} IN ('route.ts', 'route.js') AND content <> ''))"""
_NEAR = "array_to_string(string_split(content, chr(10))[greatest(line_no - 2, 1):line_no + 3], chr(10))"
_FIRST_ROUTES = f"(SELECT * FROM kept WHERE contains(path, 'config/routes.rb') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) = 1)"
_NOT_TEST = f"NOT {has_any('path', ('node_modules', '.test.', '.spec.'))}"
ROUTES = {
    "nextjs": _r("nextjs", "method", "'/' || regexp_replace(regexp_replace(regexp_replace(path, '^.*pages/api/', 'api/'), '\\.(ts|js|tsx|jsx)$', ''), '/index$', '')", AUTH_WORDS.format("content"), _PAGES)
    + " UNION ALL "
    + _r("nextjs", "method", "'/' || regexp_replace(regexp_replace(regexp_replace(path, '^.*/app/', ''), '/route\\.(ts|js)$', ''), '\\(.*?\\)/', '', 'g')", AUTH_WORDS.format("content"), _APP),
    "node": _r("node", f"upper({_g('node', 1)})", _g("node", 2), AUTH_WORDS.format(_NEAR), _hits("node", f"{RAW_EXT} IN ('.ts', '.js', '.mjs') AND {_NOT_TEST}")),
    "fastapi": _r("fastapi", f"upper({_g('fastapi', 1)})", _g("fastapi", 2), "contains(content, 'Depends') AND (contains(content, 'current_user') OR contains(content, 'oauth2_scheme'))", _hits("fastapi", "path LIKE '%.py'")),
    "django": _r("django", "'ALL'", f"'/' || {_g('django', 1)}", "contains(content, 'login_required') OR contains(content, 'IsAuthenticated')", _hits("django", f"{NAME} = 'urls.py'")),
    "rails": _r("rails", f"upper({_g('rails', 1)})", _g("rails", 2), "false", _hits("rails", "true", _FIRST_ROUTES))
    + " UNION ALL "
    + _r("rails", "mt", f"'/' || {_g('rails_resources', 1)} || sx", "false",
         f"SELECT h.*, t.* FROM ({_hits('rails_resources', 'true', _FIRST_ROUTES)}) h, {values((i, m, x) for i, (m, x) in enumerate(s.RESOURCE_ROUTES))} t(k, mt, sx)", "100000 + seq * 6 + k"),
    "spring": _r("spring", f"CASE WHEN {_g('spring', 1)} = 'Request' THEN 'ALL' ELSE upper({_g('spring', 1)}) END", _g("spring", 2), "contains(content, '@Secured') OR contains(content, '@PreAuthorize')", _hits("spring", "(path LIKE '%.java' OR path LIKE '%.kt')")),
    "laravel": _r("laravel", f"upper({_g('laravel', 1)})", _g("laravel", 2), "contains(content, '->middleware(''auth'')') OR contains(content, 'auth:')", _hits("laravel", "path LIKE '%.php' AND (contains(path, 'routes/api') OR contains(path, 'routes/web'))")),
}
_GATE = " UNION ALL ".join(
    [f"SELECT repo_id, '{x}' AS extractor FROM fw WHERE framework IN {strings(g[0])}" for x, g in s.ROUTE_GATES.items()]
    + [f"SELECT repo_id, '{x}' FROM deps WHERE dep IN {strings(g[1])}" for x, g in s.ROUTE_GATES.items() if g[1]]
)
ROUTES_ALL = (
    "routes",
    f"""SELECT r.* FROM ({' UNION ALL '.join(ROUTES.values())}) r SEMI JOIN ({_GATE}) g USING (repo_id, extractor)
QUALIFY row_number() OVER (PARTITION BY repo_id, method, route, path ORDER BY list_position({slist(s.ROUTE_GATES)}, extractor), seq) = 1""",
)
WITH_ROUTES = (*ALL_DEPS, REPOS, FW, ROUTES_ALL)

# personal-data candidates over the repository files only
REPO_HINTS = (HINT_LINES[0], HINT_LINES[1].replace("corpus_files", "kept"))

# ---- graph
_PATH_OF = "list_filter(string_split(CASE WHEN contains(src, '/') THEN regexp_replace(src, '/[^/]*$', '') ELSE '.' END || '/' || raw_import, '/'), lambda x: x NOT IN ('', '.'))"
NORMALIZED = """list_reduce(list_prepend([]::VARCHAR[], list_transform({0}, lambda x: [x])), lambda acc, x:
  CASE WHEN x[1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:-2] ELSE list_concat(acc, x) END)"""


def _norm(pieces: str) -> str:
    return f"CASE WHEN len({NORMALIZED.format(pieces)}) = 0 THEN '.' ELSE array_to_string({NORMALIZED.format(pieces)}, '/') END"


IMPORTS = ("imports", "SELECT repo_id, path AS src, v AS raw_import FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY o) AS n FROM sym_first WHERE kind = 'imports') WHERE n <= 200")
_SUFFIXES = ["", *s.RESOLVE_EXTENSIONS, *s.RESOLVE_INDEXES]
PKG = (
    "pkg_hits",
    """SELECT repo_id, src, raw_import, arg_min(package_name, manifest_path) AS package_name, arg_min(package_path, manifest_path) AS package_path
FROM imports JOIN packages USING (repo_id) WHERE package_name IS NOT NULL AND (raw_import = package_name OR starts_with(raw_import, package_name || '/')) GROUP BY ALL""",
)
EDGES = (
    "edges",
    f"""SELECT repo_id, src, CASE WHEN base IS NULL THEN raw_import ELSE coalesce(hit, CASE WHEN in_pkg THEN base END) END AS dst, base IS NULL AS is_external, in_pkg AS is_cross_package, raw_import FROM (
  SELECT b.*, (SELECT arg_min(k.path, sfx.i) FROM {values(enumerate(_SUFFIXES))} sfx(i, x) JOIN cat k ON k.path = b.base || sfx.x AND k.repo_id = b.repo_id) AS hit FROM (
    SELECT i.repo_id, i.src, i.raw_import, p.package_name IS NOT NULL AS in_pkg,
      CASE WHEN p.package_name IS NOT NULL THEN p.package_path || CASE WHEN i.raw_import = p.package_name THEN '' ELSE '/' || substring(i.raw_import, length(p.package_name) + 2) END
        WHEN i.raw_import[1] IN ('.', '/', '~') THEN {_norm(_PATH_OF.replace('raw_import', 'i.raw_import').replace('src', 'i.src'))} END AS base
    FROM imports i LEFT JOIN pkg_hits p USING (repo_id, src, raw_import)) b) WHERE base IS NULL OR hit IS NOT NULL OR in_pkg""",
)
GRAPH = (*SYMBOLS, KEPT, PACKAGES, IMPORTS, PKG, EDGES)
SRC_FILES = ("src_files", "SELECT repo_id, path FROM cat WHERE extraction_type = 'source'")
DEGREES = (
    "degrees",
    "SELECT repo_id, path, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound FROM (SELECT repo_id, dst AS path, 1 AS i, 0 AS o FROM edges WHERE NOT is_external UNION ALL SELECT repo_id, src, 0, 1 FROM edges WHERE NOT is_external) GROUP BY ALL",
)
HUBS = ("hubs", "SELECT repo_id, path, inbound FROM degrees WHERE inbound >= 5")
_DEFAULTS = f"SELECT DISTINCT repo_id, path FROM src_lines WHERE language IN ('TypeScript', 'JavaScript') AND {rx('t', s.SYMBOL_REGEXES['script']['default'])}"
ENTRIES = (
    "entries",
    f"SELECT repo_id, path FROM (SELECT DISTINCT repo_id, path FROM sym_first WHERE kind = 'exports' UNION {_DEFAULTS}) ANTI JOIN (SELECT repo_id, dst AS path FROM edges WHERE NOT is_external) USING (repo_id, path)",
)
_ENTRY_TYPE = """CASE WHEN contains(p, 'cron') OR contains(p, 'scheduler') THEN 'cron' WHEN contains(p, 'worker') OR contains(p, 'queue') THEN 'worker' WHEN contains(p, '/cli') OR contains(p, '/bin') THEN 'cli'
  WHEN contains(p, 'server') OR contains(p, 'app') OR contains(p, 'main') OR p LIKE '%index.ts' OR p LIKE '%index.js' THEN 'server' ELSE 'module' END"""


def _cycles(edges: str) -> tuple[tuple[str, str], ...]:
    """Reachability by recursive UNION; a component is the set of mutually reachable nodes."""
    return (
        ("ie", edges),
        ("reach", "WITH RECURSIVE r AS (SELECT repo_id, src, dst FROM ie UNION SELECT r.repo_id, r.src, e.dst FROM r JOIN ie e ON e.repo_id = r.repo_id AND e.src = r.dst) SELECT * FROM r"),
        ("cycles", "SELECT a.repo_id, a.src AS path, min(a.dst) AS component FROM reach a JOIN reach b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL"),
    )


# levels from the smallest member on, then back along the smallest parents
_SHOWN = (
    ("inner_edges", "SELECT e.repo_id, a.component, src, dst FROM ie e JOIN cycles a ON a.repo_id = e.repo_id AND a.path = src JOIN cycles b ON b.repo_id = e.repo_id AND b.path = dst AND a.component = b.component"),
    ("levels", """SELECT repo_id, component, path, min(d) AS d FROM (
  WITH RECURSIVE l AS (
    SELECT DISTINCT repo_id, component, component AS path, 0 AS d FROM cycles
    UNION SELECT l.repo_id, l.component, e.dst, l.d + 1 FROM l JOIN inner_edges e ON e.repo_id = l.repo_id AND e.component = l.component AND e.src = l.path
    WHERE l.d < 100 AND NOT EXISTS (SELECT 1 FROM inner_edges b WHERE b.repo_id = l.repo_id AND b.component = l.component AND b.src = l.path AND b.dst = l.component)
  ) SELECT * FROM l) GROUP BY ALL"""),
    ("ends", """SELECT repo_id, component, arg_min(path, (d, path)) AS path, min(d) AS d FROM levels l
  WHERE EXISTS (SELECT 1 FROM inner_edges e WHERE e.repo_id = l.repo_id AND e.component = l.component AND e.src = l.path AND e.dst = l.component) GROUP BY ALL"""),
    ("parents", "SELECT l.repo_id, l.component, l.path, min(e.src) AS parent FROM levels l JOIN inner_edges e ON e.repo_id = l.repo_id AND e.component = l.component AND e.dst = l.path JOIN levels p ON p.repo_id = l.repo_id AND p.component = l.component AND p.path = e.src AND p.d = l.d - 1 GROUP BY ALL"),
    ("shown", """WITH RECURSIVE w AS (
    SELECT repo_id, component, path, d FROM ends
    UNION ALL SELECT w.repo_id, w.component, p.parent, w.d - 1 FROM w JOIN parents p USING (repo_id, component, path) WHERE w.d > 0
  ) SELECT * FROM w"""),
)
_INTERNAL = "SELECT DISTINCT repo_id, src, dst FROM edges WHERE NOT is_external"
_PARTS = "SELECT DISTINCT 's' || l_suppkey AS repo_id, (l_partkey % 97)::VARCHAR AS src, (l_orderkey % 89)::VARCHAR AS dst FROM lineitem"

# ---- fingerprints
_SEG_WS = "\\t\\n\\x0b\\f\\r "


def seg(expr: str) -> str:
    """Normalized fingerprint segment."""
    stripped = f"regexp_replace(regexp_replace(regexp_replace(lower({expr}), '[0-9]+(\\.[0-9]+)*', '', 'g'), '[-_.{_SEG_WS}]+$', ''), '[-_{_SEG_WS}]+', '-', 'g')"
    return f"CASE WHEN {expr} IS NULL OR {expr} IN ('', 'unknown') OR {stripped} = '' THEN 'unknown' ELSE {stripped} END"


def aliased(expr: str, aliases: dict[str, str]) -> str:
    return f"coalesce({case_map(f'lower(trim({expr}))', aliases)}, {seg(expr)})"


def fingerprint_sql(lang: str, fw: str, orm: str, auth: str, deploy: str) -> str:
    first = f"regexp_extract({fw}, '^[^ ]*')"
    return (
        f"({seg(lang)}) || '+' || (CASE WHEN coalesce({fw}, '') = '' THEN 'unknown' ELSE {aliased(first, s.FRAMEWORK_ALIASES)} END) || '+' || "
        f"(CASE WHEN coalesce({orm}, '') = '' THEN 'unknown' ELSE {aliased(orm, s.ORM_ALIASES)} END) || '+' || "
        f"coalesce({case_map(auth, s.AUTH_ALIASES)}, {auth}, 'unknown') || '+' || {deploy}"
    )


_DEPLOY = f"""CASE WHEN kubernetes THEN 'kubernetes' WHEN has_dockerfile AND contains(lower(c.targets), 'vercel') THEN 'vercel' WHEN has_dockerfile AND contains(lower(c.targets), 'heroku') THEN 'heroku'
  WHEN has_dockerfile THEN 'docker' WHEN c.targets = '' THEN 'unknown' WHEN contains(t1, 'vercel') THEN 'vercel' WHEN contains(t1, 'heroku') THEN 'heroku' WHEN contains(t1, 'nginx') THEN 'nginx'
  WHEN contains(t1, 'vps') THEN 'vps' ELSE {seg('t1')} END"""
_AUTH_ORDER = slist(t for t, _ in s.AUTH_FILE_REGEXES)
STACKS = (
    "stacks",
    f"""SELECT r.repo_id, coalesce(l.lang, 'Unknown') AS lang, f.primary_framework AS fw, o.orm, a.auth, c.* EXCLUDE (repo_id), lower(string_split(c.targets, ',')[1]) AS t1
FROM repos r LEFT JOIN (SELECT repo_id, arg_min(language, {{'n': -n, 'p': p}}) AS lang FROM (SELECT repo_id, language, count(*) AS n, min(path) AS p FROM (SELECT *, {LANG} AS language FROM kept) WHERE language IN {strings(s.SOURCE_LANGUAGES)} GROUP BY ALL) GROUP BY repo_id) l USING (repo_id)
LEFT JOIN frameworks_inv f USING (repo_id) LEFT JOIN orm o USING (repo_id)
LEFT JOIN (SELECT repo_id, arg_min(auth_type, CASE WHEN source = 'dependency' THEN 0 ELSE coalesce(list_position({_AUTH_ORDER}, auth_type), 0) END) AS auth FROM auth_inv GROUP BY repo_id) a USING (repo_id)
LEFT JOIN cicd c USING (repo_id)""",
)

_UNDER = " OR ".join(f"starts_with(path, '{p}')" for p in ("src/", "packages/core", "app/"))

ORACLES = {
    "dep_frameworks": with_(*ALL_DEPS, FW, select="SELECT * FROM fw"),
    "framework_inventory": with_(*ALL_DEPS, FW, FW_LIST, MANIFEST_COUNT, FRAMEWORKS, select="SELECT * FROM frameworks_inv"),
    "dep_db_engines": with_(*ALL_DEPS, ENGINES, select="SELECT * FROM engines"),
    "dep_orm": with_(*ALL_DEPS, ORM, select="SELECT * FROM orm"),
    "dep_migration_tool": with_(*ALL_DEPS, TOOL, select="SELECT * FROM migration_tools"),
    "migration_count": with_(*REPO, KEPT, select=f"SELECT repo_id, sum({MIGRATION_HITS})::BIGINT AS migrations FROM kept GROUP BY repo_id"),
    "connection_env_vars": with_(*REPO, KEPT, CONN, select="SELECT * FROM conn"),
    "database_inventory": with_(
        *ALL_DEPS, ENGINES, ORM, TOOL, CONN,
        select=f"""SELECT r.*, orm, migration_tool, coalesce(e.l, '') AS engines, coalesce(c.l, '') AS connection_env_vars
FROM (SELECT repo_id, sum({MIGRATION_HITS})::BIGINT AS migrations, count(*) FILTER ({IS_SCHEMA}) AS schema_files FROM kept GROUP BY repo_id) r JOIN orm USING (repo_id) JOIN migration_tools USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(engine, ',' ORDER BY engine) AS l FROM engines GROUP BY repo_id) e USING (repo_id) LEFT JOIN (SELECT repo_id, string_agg(env_name, ',' ORDER BY env_name) AS l FROM conn GROUP BY repo_id) c USING (repo_id)""",
    ),
    "phi_tables": with_(
        *REPO, KEPT, REPOS, REPO_HINTS,
        select=f"SELECT r.repo_id, h.repo_id IS NOT NULL AS phi_tables FROM repos r LEFT JOIN (SELECT DISTINCT c.repo_id FROM hinted c JOIN (SELECT repo_id, path FROM kept WHERE {IS_SCHEMA}) k ON c.repo_id = k.repo_id AND starts_with(c.path, k.path)) h USING (repo_id)",
    ),
    "dep_auth_type": with_(*ALL_DEPS, AUTH_DEP, select="SELECT * FROM auth_dep"),
    "auth_files": with_(*REPO, KEPT, AUTH_FILES, select="SELECT * FROM auth_files"),
    "auth_inventory": with_(*WITH_ROUTES, AUTH_DEP, AUTH_FILES, AUTH, select="SELECT * FROM auth_inv"),
    "dep_test_frameworks": with_(*ALL_DEPS, TEST_FW, select="SELECT DISTINCT repo_id, framework FROM test_fw"),
    "coverage_tooling": with_(*ALL_DEPS, COVERAGE, select="SELECT * FROM coverage"),
    "test_inventory": with_(
        *ALL_DEPS, TEST_FW, COVERAGE,
        select=f"""SELECT r.repo_id, test_files, coalesce(f.l, array_to_string(list_filter([CASE WHEN a THEN 'RSpec' END, CASE WHEN b THEN 'pytest' END, CASE WHEN c THEN 'Go test' END], lambda x: x IS NOT NULL), ',')) AS test_frameworks,
  v.repo_id IS NOT NULL AS coverage_tooling, coverage_directory
FROM (SELECT repo_id, count(*) FILTER ({IS_TEST}) AS test_files, bool_or({NAME} LIKE '%\\_spec.rb' ESCAPE '\\') AS a, bool_or({NAME} IN ('pytest.ini', 'conftest.py')) AS b, bool_or({NAME} LIKE '%\\_test.go' ESCAPE '\\') AS c,
  bool_or(list_has_any(string_split(path, '/')[1:-2], {slist(s.COVERAGE_DIRS)})) AS coverage_directory FROM kept GROUP BY repo_id) r
LEFT JOIN (SELECT repo_id, string_agg(framework, ',' ORDER BY framework) AS l FROM (SELECT DISTINCT repo_id, framework FROM test_fw) GROUP BY repo_id) f USING (repo_id) LEFT JOIN coverage v USING (repo_id)""",
    ),
    "dependency_listing": with_(*ALL_DEPS, select="SELECT repo_id, is_dev, file, dep_pos, dep || '@' || dep_version AS label, count(*) OVER (PARTITION BY repo_id, is_dev) AS section_size FROM deps"),
    "infra_flags": with_(*REPO, KEPT, FLAGS, select="SELECT * FROM flags"),
    "deployment_targets": with_(*INFRA, select="SELECT * FROM targets"),
    "cicd_inventory": with_(*INFRA, select="SELECT * FROM cicd"),
    "ci_tools": with_(
        *INFRA,
        select="SELECT repo_id, array_to_string(list_filter([CASE WHEN workflows > 0 THEN 'GitHub Actions' END, CASE WHEN has_dockerfile THEN 'Docker' END, CASE WHEN kubernetes THEN 'Kubernetes' END, CASE WHEN helm THEN 'Helm' END, CASE WHEN makefile THEN 'Make' END], lambda x: x IS NOT NULL), ',') AS tools FROM cicd",
    ),
    **{f"routes_{x}": with_(*REPO, KEPT, select=sql) for x, sql in ROUTES.items()},
    "union_routes": with_(*WITH_ROUTES, select="SELECT * FROM routes"),
    "route_auth_split": with_(*WITH_ROUTES, select="SELECT repo_id, count(*) FILTER (auth_required) AS protected, count(*) FILTER (NOT auth_required) AS unprotected, count(*) FILTER (auth_required) / count(*) AS coverage FROM routes GROUP BY repo_id"),
    "health_check_present": with_(*WITH_ROUTES, select=f"SELECT repo_id, bool_or(route IN {strings(s.HEALTH_PATHS)} OR '/' || string_split(route, '/')[-1] IN {strings(s.HEALTH_PATHS)}) AS has_health_check FROM routes GROUP BY repo_id"),
    "phi_adjacent_routes": with_(*WITH_ROUTES, REPO_HINTS, select="SELECT repo_id, method, route, path, line_no, auth_required, h.path IS NOT NULL AS phi_adjacent FROM routes LEFT JOIN (SELECT DISTINCT repo_id, path FROM hinted) h USING (repo_id, path)"),
    "resolve_relative_path": f"""SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'x/p' || l_partkey WHEN 1 THEN '../../p' || l_partkey ELSE 'src/o' || l_orderkey || '/a/p' || l_partkey END AS resolved FROM lineitem""",
    "import_edges": with_(*GRAPH, select="SELECT * FROM edges"),
    "cross_package_imports": with_(*GRAPH, select="SELECT repo_id, src, raw_import, dst FROM edges WHERE is_cross_package"),
    "degree_counts": with_(*GRAPH, DEGREES, select="SELECT * FROM degrees"),
    "hub_files": with_(*GRAPH, DEGREES, HUBS, select="SELECT * FROM hubs"),
    "entry_points": with_(*GRAPH, ENTRIES, select="SELECT * FROM entries"),
    "top_entry_points": with_(*GRAPH, ENTRIES, select=f"SELECT repo_id, path, entry_rank, {_ENTRY_TYPE} AS entry_type FROM (SELECT *, lower(path) AS p, (row_number() OVER (PARTITION BY repo_id ORDER BY path))::INTEGER AS entry_rank FROM entries) WHERE entry_rank <= 10"),
    "leaf_files": with_(*GRAPH, SRC_FILES, select="SELECT repo_id, path FROM src_files ANTI JOIN (SELECT repo_id, src AS path FROM edges WHERE NOT is_external) USING (repo_id, path)"),
    "key_modules": with_(
        *GRAPH, DEGREES, HUBS,
        select="""SELECT h.repo_id, h.path, string_split(h.path, '/')[-1] AS name, CASE WHEN c.extraction_type = 'source' AND x.e <> '' THEN x.e WHEN c.extraction_type = 'config' THEN 'configuration' WHEN c.extraction_type = 'schema' THEN 'data schema' ELSE 'shared module' END AS purpose, inbound, module_rank
FROM (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY path))::INTEGER AS module_rank FROM hubs QUALIFY module_rank <= 15) h LEFT JOIN cat c USING (repo_id, path)
LEFT JOIN (SELECT repo_id, path, array_to_string(list(v ORDER BY o)[1:3], ', ') AS e FROM sym_first WHERE kind = 'exports' GROUP BY ALL) x USING (repo_id, path)""",
    ),
    "rank_sources_capped": with_(
        *GRAPH, SRC_FILES, DEGREES, HUBS, ENTRIES,
        select="""SELECT repo_id, path, inbound, outbound, pinned, pinned OR rn <= greatest(20 - np, 0) AS in_detail FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, pinned ORDER BY inbound DESC, outbound DESC, path) AS rn, count(*) FILTER (pinned) OVER (PARTITION BY repo_id) AS np FROM (
    SELECT f.repo_id, f.path, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, p.path IS NOT NULL AS pinned FROM src_files f LEFT JOIN degrees USING (repo_id, path)
    LEFT JOIN (SELECT repo_id, path FROM hubs UNION SELECT * FROM entries) p USING (repo_id, path)))""",
    ),
    "import_cycles": with_(*GRAPH, *_cycles(_INTERNAL), select="SELECT * FROM cycles"),
    "cycle_paths": with_(*_cycles(_PARTS), *_SHOWN, select="SELECT repo_id, component, d::INTEGER AS step, path FROM shown"),
    "part_graph_cycles": with_(*_cycles(_PARTS), select="SELECT * FROM cycles"),
    "slice_by_prefix": with_(*REPO, KEPT, select=f"SELECT repo_id, path FROM kept WHERE {_UNDER}"),
    "slice_edges": with_(*GRAPH, select="SELECT * FROM edges WHERE starts_with(src, 'packages/') OR starts_with(dst, 'packages/')"),
    "slice_by_prefix_table": with_(*REPO, KEPT, select="SELECT repo_id, path, 'sources' AS slice FROM kept WHERE starts_with(path, 'src/') UNION ALL SELECT repo_id, path, 'data' FROM kept WHERE starts_with(path, 'data/')"),
    "slice_cycles": with_(*_cycles(_PARTS), select="SELECT * FROM cycles SEMI JOIN (SELECT DISTINCT repo_id, component FROM cycles WHERE starts_with(path, '1') OR starts_with(path, '2')) USING (repo_id, component)"),
    "repo_fingerprints": with_(
        *WITH_ROUTES, FW_LIST, MANIFEST_COUNT, FRAMEWORKS, ORM, WORKFLOWS, FLAGS, TARGETS, CICD, AUTH_DEP, AUTH_FILES, AUTH, STACKS,
        select=f"SELECT repo_id, {fingerprint_sql('lang', 'fw', 'orm', 'auth', f'({_DEPLOY})').replace('c.targets', 'targets')} AS fingerprint, {case_map('lang', s.RUNTIMES)} AS runtime FROM stacks",
    ),
}
