"""HTTP routes of eight web frameworks.

Each extractor is a filter on paths, one generator over the file's own text and a projection.  Routes are narrow
rows; the gate (does the repository use the framework?) is a semi-join on them, so file contents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.paths import basename, extname
from factloom.functions.ranking import first_per_key
from factloom.functions.regex import blocks_sql, line_sql, line_starts_sql, spans_sql, sql_literal, to_java

ROUTE = "struct<extractor:string,method:string,route:string,line_no:int,auth_required:boolean,seq:int>"
_NONE = f"cast(array() as array<{ROUTE}>)"
_NOT_TEST = "NOT contains(path, 'node_modules') AND NOT contains(path, '.test.') AND NOT contains(path, '.spec.')"


def auth_words_sql(text: str) -> str:
    """Text mentions auth together with a guarding word."""
    words = " OR ".join(f"contains({text}, '{w}')" for w in ("middleware", "guard", "verify", "authenticate"))
    return f"(contains({text}, 'auth') AND ({words}))"


def _rx(key: str) -> str:
    return to_java(*signals.ROUTE_REGEXES[key])


def _part(key: str, n: int) -> str:
    return f"regexp_extract(h.m, {sql_literal(_rx(key))}, {n})"


def _route(extractor: str, method: str, route: str, line: str, auth: str, seq: str) -> str:
    return (
        f"named_struct('extractor', '{extractor}', 'method', {method}, 'route', {route}, 'line_no', cast({line} as int), "
        f"'auth_required', {auth}, 'seq', cast({seq} as int))"
    )


def _hits(key: str) -> str:
    """Matches of a route regex with their line: array<struct<m, line_no, i>>."""
    hits = f"transform({spans_sql('content', _rx(key))}, (s, i) -> named_struct('m', s.matched, 'line_no', {line_sql('b', 'n', 's.start_pos')}, 'i', i + 1))"
    return f"transform(array({blocks_sql('content')}), b -> transform(array({line_starts_sql('b')}), n -> {hits})[0])[0]"


def _declared(extractor: str, key: str, method: str, route: str, auth: str) -> str:
    return f"transform({_hits(key)}, h -> {_route(extractor, method, route, 'h.line_no', auth, 'h.i')})"


def _guarded(condition: str, routes: str) -> str:
    return f"CASE WHEN {condition} THEN {routes} ELSE {_NONE} END"


def _nextjs_sql() -> str:
    pages = "regexp_replace(regexp_replace(regexp_replace(path, '^.*pages/api/', 'api/'), '[.](?:ts|js|tsx|jsx)$', ''), '/index$', '')"
    methods = ", ".join(f"'{m}'" for m in signals.HTTP_METHODS)
    named = f"filter(transform(regexp_extract_all(content, {sql_literal(_rx('pages_method'))}, 1), x -> upper(x)), x -> x IN ({methods}))"
    page_methods = f"CASE WHEN size({named}) > 0 THEN {named} ELSE array('ALL') END"
    auth = auth_words_sql("content")
    page_routes = f"transform({page_methods}, (m, i) -> {_route('nextjs', 'm', f'concat(\'/\', {pages})', '1', auth, 'i')})"

    def declares(text: str, method: str) -> str:
        return f"{text} RLIKE {sql_literal(to_java(rf'export\s+(?:async\s+)?function\s+{method}\b'))}"

    app = "regexp_replace(regexp_replace(regexp_replace(path, '^.*/app/', ''), '/route[.](?:ts|js)$', ''), '[(].*?[)]/', '')"
    each = [
        f"CASE WHEN {declares('content', m)} THEN named_struct('m', '{m}', 'line_no', greatest(array_position("
        f"transform(split(content, '\n', -1), l -> {declares('l', m)}), true), 1)) END"
        for m in signals.HTTP_METHODS
    ]
    present = f"array_compact(array({', '.join(each)}))"
    exported = f"CASE WHEN size({present}) > 0 THEN {present} ELSE array(named_struct('m', 'ALL', 'line_no', 1L)) END"
    app_routes = f"transform({exported}, (h, i) -> {_route('nextjs', 'h.m', f'concat(\'/\', {app})', 'h.line_no', auth, 'i')})"
    is_page = "contains(path, 'pages/api/') AND ext IN ('.ts', '.js', '.tsx', '.jsx')"
    is_app = "contains(path, '/app/') AND name IN ('route.ts', 'route.js') AND content <> ''"
    return f"concat({_guarded(is_page, page_routes)}, {_guarded(is_app, app_routes)})"


def _node_sql() -> str:
    # the two lines above and the three below the route's own line
    near = "array_join(slice(split(content, '\n', -1), greatest(h.line_no - 2, 1), h.line_no + 4 - greatest(h.line_no - 2, 1)), '\n')"
    routes = _declared("node", "node", f"upper({_part('node', 1)})", _part("node", 2), auth_words_sql(near))
    return _guarded(f"ext IN ('.ts', '.js', '.mjs') AND {_NOT_TEST}", routes)


def _fastapi_sql() -> str:
    auth = "(contains(content, 'Depends') AND (contains(content, 'current_user') OR contains(content, 'oauth2_scheme')))"
    routes = _declared("fastapi", "fastapi", f"upper({_part('fastapi', 1)})", _part("fastapi", 2), auth)
    return _guarded("endswith(path, '.py') AND contains(content, '@')", routes)


def _django_sql() -> str:
    auth = "(contains(content, 'login_required') OR contains(content, 'IsAuthenticated'))"
    return _guarded("name = 'urls.py'", _declared("django", "django", "'ALL'", f"concat('/', {_part('django', 1)})", auth))


def _rails_sql() -> str:
    plain = _declared("rails", "rails", f"upper({_part('rails', 1)})", _part("rails", 2), "false")
    template = "array(" + ", ".join(f"named_struct('verb', '{m}', 'suffix', '{x}')" for m, x in signals.RESOURCE_ROUTES) + ")"
    path = f"concat('/', {_part('rails_resources', 1)}, t.suffix)"
    one = _route("rails", "t.verb", path, "h.line_no", "false", f"100000 + h.i * {len(signals.RESOURCE_ROUTES)} + k")
    resources = f"flatten(transform({_hits('rails_resources')}, h -> transform({template}, (t, k) -> {one})))"
    return _guarded("contains(path, 'config/routes.rb')", f"concat({plain}, {resources})")


def _spring_sql() -> str:
    verb = _part("spring", 1)
    auth = "(contains(content, '@Secured') OR contains(content, '@PreAuthorize'))"
    routes = _declared("spring", "spring", f"CASE WHEN {verb} = 'Request' THEN 'ALL' ELSE upper({verb}) END", _part("spring", 2), auth)
    return _guarded("(endswith(path, '.java') OR endswith(path, '.kt')) AND contains(content, 'Mapping')", routes)


def _laravel_sql() -> str:
    auth = "(contains(content, '->middleware(\\'auth\\')') OR contains(content, 'auth:'))"
    routes = _declared("laravel", "laravel", f"upper({_part('laravel', 1)})", _part("laravel", 2), auth)
    return _guarded("endswith(path, '.php') AND (contains(path, 'routes/api') OR contains(path, 'routes/web'))", routes)


EXTRACTORS = {
    "nextjs": _nextjs_sql, "node": _node_sql, "fastapi": _fastapi_sql, "django": _django_sql, "rails": _rails_sql,
    "spring": _spring_sql, "laravel": _laravel_sql,
}


def extract_routes(files: DataFrame, extractors=tuple(EXTRACTORS)) -> DataFrame:
    """(repo_id, extractor, method, route, path, line_no, auth_required, seq) of the chosen extractors, from one scan of the
    files: every extractor is an expression over the file's own path and content."""
    name = basename(F.col("path"))
    base = files.select("repo_id", "path", "content", name.alias("name"), extname(name).alias("ext"))
    arrays = ", ".join(EXTRACTORS[x]() for x in extractors)
    rows = base.select("repo_id", "path", F.explode(F.expr(f"concat({arrays})")).alias("r"))
    flat = rows.select("repo_id", "r.extractor", "r.method", "r.route", "path", "r.line_no", "r.auth_required", "r.seq")
    if "rails" not in extractors:
        return flat
    # one routes file counts per repository, the first by path (read from the paths alone)
    first = files.filter(F.col("path").contains("config/routes.rb")).groupBy("repo_id").agg(F.min("path").alias("_first"))
    kept = flat.join(first, "repo_id", "left").filter((F.col("extractor") != "rails") | (F.col("path") == F.col("_first")))
    return kept.drop("_first")


def dedupe_routes(routes: DataFrame) -> DataFrame:
    """First route per (method, route, file) in extractor order, then text order."""
    order = F.array_position(F.array(*[F.lit(x) for x in EXTRACTORS]), F.col("extractor"))
    keyed = routes.withColumn("_order", order)
    return first_per_key(
        keyed, ["repo_id", "method", "route", "path"], [F.col("_order"), F.col("seq")]
    ).drop("_order")


def route_gates(deps: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(repo_id, extractor) pairs that a repository's frameworks and dependencies switch on."""

    def pairs(df: DataFrame, column: str, which: int) -> DataFrame:
        on = F.array(*[
            F.when(F.col(column).isin(*gate[which]), F.lit(x)) if gate[which] else F.lit(None).cast("string")
            for x, gate in signals.ROUTE_GATES.items()
        ])
        return df.select("repo_id", F.explode(F.array_compact(on)).alias("extractor"))

    return pairs(frameworks, "framework", 0).unionByName(pairs(deps, "dep", 1)).distinct()


def union_routes(files: DataFrame, deps: DataFrame, frameworks: DataFrame) -> DataFrame:
    """All routes of all extractors a repository switches on, deduplicated."""
    gated = extract_routes(files).join(route_gates(deps, frameworks), ["repo_id", "extractor"], "left_semi")
    return dedupe_routes(gated)


# ---------------------------------------------------------------- over the routes


def auth_coverage(routes: DataFrame) -> DataFrame:
    out = routes.groupBy("repo_id").agg(
        F.count_if("auth_required").alias("protected"), F.count_if(~F.col("auth_required")).alias("unprotected")
    )
    return out.withColumn("coverage", F.col("protected") / (F.col("protected") + F.col("unprotected")))


def health_check_present(routes: DataFrame) -> DataFrame:
    last = F.concat(F.lit("/"), F.substring_index("route", "/", -1))
    hit = F.col("route").isin(*signals.HEALTH_PATHS) | last.isin(*signals.HEALTH_PATHS)
    return routes.groupBy("repo_id").agg(F.bool_or(hit).alias("has_health_check"))


def phi_adjacent_routes(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Routes with a flag: does the route's file hold a personal-data candidate?"""
    marked = candidates.select("repo_id", "path").distinct().withColumn("_hit", F.lit(True))
    return routes.join(marked, ["repo_id", "path"], "left").select(
        "repo_id", "method", "route", "path", "line_no", "auth_required",
        F.col("_hit").isNotNull().alias("phi_adjacent"),
    )
