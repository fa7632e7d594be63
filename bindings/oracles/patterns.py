"""Oracle SQL of ``bindings.q_patterns``."""

from __future__ import annotations

from bindings.oracles.common import lit, slist, strings, values, with_
from bindings.oracles.facts import aliased, fingerprint_sql, seg
from bindings.oracles.files import case_map
from bindings.q_patterns import AUTHS, DEPLOYS, DIMS, FRAMEWORKS, LANGS, ORMS
from factloom import signals as s
from factloom.functions.regex import WS_CHARS, to_re2

WS = lit(WS_CHARS)


def r4(x: str, d: int = 4) -> str:
    return f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"


def pick(items, key: str) -> str:
    return f"({slist(items)})[(({key}) % {len(items)})::INTEGER + 1]"


def fp(k: str) -> str:
    return " || '+' || ".join([
        pick(LANGS, k), pick(FRAMEWORKS, f"({k}) // 5"), pick(ORMS, f"({k}) // 7"), pick(AUTHS, f"({k}) // 3"), pick(DEPLOYS, f"({k}) // 11"),
    ])


PATTERNS = (
    "pats",
    f"""SELECT 'p' || p_partkey AS pattern_id, {fp('p_partkey * 3')} AS fingerprint, p_partkey AS store_ord,
  CASE WHEN p_partkey % 10 = 0 THEN 'deprecated' WHEN p_partkey % 3 = 0 THEN 'probation' ELSE 'active' END AS status, p_partkey % 13 AS use_count,
  least(p_partkey % 13, p_partkey % 4) AS probation_uses, least(p_partkey % 13, p_partkey % 7) AS success_count, (p_partkey % 90) / 100.0::DOUBLE AS avg_savings,
  (p_partkey % 101) / 100.0::DOUBLE AS fitness_score, CASE WHEN p_partkey % 5 > 0 THEN (DATE '2023-09-01' + (p_partkey % 190)::INTEGER)::TIMESTAMP END AS last_used_at FROM part""",
)
QUERIES_ = (
    "qs",
    f"SELECT c_custkey AS query_id, CASE WHEN c_custkey % 9 = 0 THEN array_to_string(string_split(f, '+')[1:4], '+') ELSE f END AS fingerprint FROM (SELECT c_custkey, {fp('c_custkey * 7 + 1')} AS f FROM customer)",
)
_SIM = (
    "CASE WHEN a = b THEN 1.0 WHEN a = 'unknown' OR b = 'unknown' THEN 0.3 WHEN "
    + " OR ".join(f"(a IN {strings(g)} AND b IN {strings(g)})" for g in s.RELATED_SEGMENTS) + " THEN 0.5 ELSE 0.0 END"
)


def sim(a: str, b: str) -> str:
    """Similarity as a correlated scalar over segment numbers."""
    return f"""(SELECT sum({_SIM})::DOUBLE / count(*) FROM (SELECT coalesce(string_split({a}, '+')[i], 'unknown') AS a, coalesce(string_split({b}, '+')[i], 'unknown') AS b
  FROM (SELECT unnest(range(1, greatest(len(string_split({a}, '+')), len(string_split({b}, '+'))) + 1)) AS i)))"""


PAIRS = (
    "pairs",
    f"""SELECT q, p, sum({_SIM})::DOUBLE / count(*) AS score FROM (
  SELECT q, p, coalesce(string_split(q, '+')[i], 'unknown') AS a, coalesce(string_split(p, '+')[i], 'unknown') AS b FROM (
    SELECT q, p, unnest(range(1, greatest(len(string_split(q, '+')), len(string_split(p, '+'))) + 1)) AS i
    FROM (SELECT DISTINCT fingerprint AS q FROM qs), (SELECT DISTINCT fingerprint AS p FROM pats WHERE status <> 'deprecated'))) GROUP BY q, p""",
)
EXACT = "SELECT q.*, p.pattern_id, 1.0::DOUBLE AS match_score, 'exact' AS match_type FROM qs q JOIN (SELECT fingerprint, arg_min(pattern_id, store_ord) AS pattern_id FROM pats WHERE status <> 'deprecated' GROUP BY 1) p USING (fingerprint)"


def fuzzy(t: float) -> str:
    return f"""SELECT q.query_id, q.fingerprint, w.pattern_id, {r4('w.score')} AS match_score, 'fuzzy' AS match_type FROM qs q JOIN (
  SELECT pairs.q, pattern_id, score FROM pairs JOIN pats ON pats.fingerprint = pairs.p WHERE status <> 'deprecated' AND score >= {t} - 1e-9
  QUALIFY row_number() OVER (PARTITION BY pairs.q ORDER BY round(score, 9) DESC, fitness_score DESC, store_ord) = 1) w ON w.q = q.fingerprint"""


# ---- fitness
USES = ("uses", "SELECT 'u' || user_id AS fingerprint, event_id AS use_id, ts AS used_at, event_type <> 'error' AS success, least(value / 500, 1.0) AS savings FROM events")


def recency(t: str) -> str:
    d = f"(epoch_us(TIMESTAMP '2024-03-15 00:00:00') - epoch_us({t})) / 86400000000.0"
    return f"CASE WHEN {t} IS NULL THEN 0.1::DOUBLE WHEN {d} < 30 THEN 1.0 WHEN {d} < 90 THEN 0.7 WHEN {d} < 180 THEN 0.4 ELSE 0.1 END"


NUMBERED = ("numbered", "SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY used_at, use_id) AS n FROM uses")
_AVG1 = r4("u.savings")
FOLD = (
    "fold",
    f"""WITH RECURSIVE f AS (
  SELECT fingerprint, use_id, used_at, success, n AS use_count, 1::BIGINT AS probation_uses, success::BIGINT AS success_count, {r4('savings')} AS avg_savings,
    {r4(f"success::INTEGER * 0.6 + {r4('savings')} * 0.3 + 0.1")} AS fitness_score, 'probation' AS status, 0.0::DOUBLE AS history_score, 0::BIGINT AS history_use_count FROM numbered WHERE n = 1
  UNION ALL
  SELECT fingerprint, use_id, used_at, success, n, pu, sc, av, {r4('sc::DOUBLE / n * 0.6 + av * 0.3 + 0.1')}, CASE WHEN st = 'probation' AND pu >= 3 AND sc > 0 THEN 'active' ELSE st END, hs, hc FROM (
    SELECT u.fingerprint, u.use_id, u.used_at, u.success, u.n, f.probation_uses + (f.status = 'probation')::BIGINT AS pu, f.success_count + u.success::BIGINT AS sc,
      {r4('(f.avg_savings * f.use_count + u.savings) / u.n')} AS av, f.status AS st, f.fitness_score AS hs, f.use_count AS hc
    FROM f JOIN numbered u ON u.fingerprint = f.fingerprint AND u.n = f.use_count + 1)
) SELECT * FROM f""",
)

# ---- findings
FINDINGS = (
    "findings",
    f"""SELECT 'repo-' || o_custkey AS repo_id, {pick(DIMS, 'o_orderkey')} AS dimension, sev AS severity,
  'Missing control ' || o_orderkey % 40 || ' in src/o' || o_orderkey % 40 || '.ts lines 10-12:7 of module' AS description, 'src/o' || o_orderkey || '/l1.ts' AS file,
  (CASE sev WHEN 'P0' THEN 25 WHEN 'P1' THEN 15 WHEN 'P2' THEN 8 ELSE 3 END + o_orderkey % 3)::DOUBLE AS deduction, o_orderkey AS ord
FROM (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'P0' WHEN '2' THEN 'P1' WHEN '3' THEN 'P2' ELSE 'P3' END AS sev FROM orders)""",
)
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 75 THEN 'B' WHEN {0} >= 60 THEN 'C' WHEN {0} >= 40 THEN 'D' ELSE 'F' END"
SCORES = ("scores", f"SELECT repo_id, dimension, greatest(0.0, 100.0 - sum(deduction))::DOUBLE AS score FROM findings GROUP BY ALL")
_N = "substring(repo_id, 6)::BIGINT"
_W1 = "coalesce(" + case_map("dimension", {k: str(v) for k, v in s.DIMENSION_WEIGHTS.items()}) + "::DOUBLE, 0)"
_W2 = "coalesce(" + case_map("dimension", {k: str(v) for k, v in s.DIMENSION_WEIGHTS_NO_COMPLIANCE.items()}) + "::DOUBLE, 0)"


def clean(x: str) -> str:
    for rx, flags, rep in s.SANITIZE_RULES:
        x = f"regexp_replace({x}, {lit(to_re2(rx, flags))}, {lit(rep)}, 'g')"
    return f"trim({x}, {WS})"


def fence(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {lit(to_re2(r, f))}) THEN {i}" for i, (r, f) in enumerate(s.FENCE_REGEXES, 1)) + " END"


SIGHTINGS = ("sightings", "SELECT DISTINCT 'u' || user_id AS fingerprint, 'Security' AS dimension, event_type AS gap, day(ts)::BIGINT AS use_no FROM events")
GAPS = (
    "gaps",
    f"""SELECT fingerprint, dimension, gap, coalesce(s.severity, f.severity) AS severity,
  CASE WHEN f.severity IS NULL THEN frequency WHEN s.severity IS NULL THEN {r4('1.0::DOUBLE / u.n')} ELSE {r4('(frequency * (u.n - 1) + 1) / u.n')} END AS frequency
FROM (SELECT 'repo-' || c_custkey AS fingerprint, {pick(DIMS, 'kind')} AS dimension, 'Missing control ' || kind || ' in [source-file] [location] of module' AS gap, 'P2' AS severity, kind / 40.0::DOUBLE AS frequency
      FROM customer, (SELECT unnest(range(1, 40, 2)) AS kind)) s
FULL JOIN (SELECT repo_id AS fingerprint, dimension, {clean('description')} AS gap, arg_min(severity, ord) AS severity FROM findings GROUP BY ALL) f USING (fingerprint, dimension, gap)
JOIN (SELECT 'repo-' || c_custkey AS fingerprint, c_custkey % 9 + 1 AS n FROM customer) u USING (fingerprint)""",
)
FOUND_JSON = (
    "found_json",
    """SELECT *, (ord % 19 <> 0 AND ord % 11 <> 0 AND ord % 13 <> 0 AND ord % 17 <> 0) AS ok FROM findings""",
)

_PRICES = values((m, float(i), float(o), "fast" if f else "thorough") for m, i, o, f in s.MODEL_PRICES)


def facts(source: str, key: str) -> str:
    return f"""SELECT {key}, len(v)::INTEGER AS dims, {r4('list_sum(list_transform(v, lambda x: x * x))', 6)} AS squared_norm,
  {r4('list_sum(list_transform(v, lambda x, i: x * i))')} AS weighted_sum, sha256(array_to_string(list_transform(v, lambda x: floor(x * 1e9 + 0.5)::BIGINT::VARCHAR), ',')) AS values_hash
FROM ({source})"""


def _unit(raw: str) -> str:
    return f"list_transform({raw}, lambda x: x / n)"


_RAW_HASH = "flatten(list_transform(range(0, 192), lambda i: list_transform(range(0, 8), lambda j: (((('0x' || substring(sha256(i || ':' || text), j * 8 + 1, 8))::BIGINT + 2147483648) % 4294967296 - 2147483648) / 2147483648.0::DOUBLE) - 1)))"
_NORM = "sqrt(list_reduce(list_prepend(0.0::DOUBLE, w), lambda a, x: a + x * x))"
_DOWN = "list_transform(range(0, 24), lambda i: list_avg(e[floor(i * (64 / 24.0::DOUBLE))::INTEGER + 1:floor((i + 1) * (64 / 24.0::DOUBLE))::INTEGER]))"

ORACLES = {
    "segment_normalize": f"SELECT p_partkey, {seg('raw')} AS segment, ({seg('p_brand')}) || '+' || ({seg('p_name')}) || '+unknown' AS fingerprint FROM (SELECT *, p_type || ' - ' || p_brand || '.' || p_size || '_' AS raw FROM part)",
    "fingerprint": f"""SELECT p_partkey, {fingerprint_sql('lang', 'fw', 'orm', 'auth', '''(CASE WHEN k % 6 = 0 THEN 'kubernetes' WHEN k % 2 = 0 AND list_contains(list_transform(t, lambda x: contains(lower(x), 'vercel')), true) THEN 'vercel'
  WHEN k % 2 = 0 AND list_contains(list_transform(t, lambda x: contains(lower(x), 'heroku')), true) THEN 'heroku' WHEN k % 2 = 0 THEN 'docker' WHEN len(t) = 0 THEN 'unknown'
  WHEN contains(t1, 'vercel') THEN 'vercel' WHEN contains(t1, 'heroku') THEN 'heroku' WHEN contains(t1, 'nginx') THEN 'nginx' WHEN contains(t1, 'vps') THEN 'vps' ELSE ''' + seg('t1') + ''' END)''')} AS fingerprint
FROM (SELECT *, lower(t[1]) AS t1 FROM (SELECT p_partkey, p_partkey AS k, {pick(('TypeScript', 'C#', 'Go 1.21', 'Unknown', ''), 'p_partkey')} AS lang,
  {pick(('Next.js', 'Spring Boot', 'FastAPI', 'Ruby on Rails', '@nestjs/core', ''), 'p_partkey')} AS fw, {pick(('drizzle-orm', '@prisma/client', 'SQLAlchemy 2.0', 'Django ORM', ''), 'p_partkey // 2')} AS orm,
  {pick(('jwt', 'magic_link', 'custom'), 'p_partkey')} AS auth, CASE WHEN p_partkey % 7 = 0 THEN []::VARCHAR[] WHEN p_partkey % 4 = 0 THEN [{pick(('Docker', 'Vercel', 'Heroku', 'Nginx box', 'My VPS', 'Fly.io'), 'p_partkey')}, 'Vercel']
    ELSE [{pick(('Docker', 'Vercel', 'Heroku', 'Nginx box', 'My VPS', 'Fly.io'), 'p_partkey')}] END AS t FROM part))""",
    "segment_similarity": with_(PATTERNS, select=f"SELECT pattern_id, {sim('fingerprint', lit('typescript+hono+drizzle+jwt+docker'))} AS similarity, {sim('fingerprint', lit('typescript+hono'))} AS similarity_short FROM pats"),
    "eligible_patterns": with_(PATTERNS, select="SELECT pattern_id, fingerprint, status FROM pats WHERE status <> 'deprecated'"),
    "pattern_exact_match": with_(PATTERNS, QUERIES_, select=EXACT),
    "pattern_fuzzy_match": with_(PATTERNS, QUERIES_, PAIRS, select=fuzzy(0.85)),
    "pattern_fuzzy_match_wide": with_(PATTERNS, QUERIES_, PAIRS, select=fuzzy(0.75)),
    "query_patterns": with_(
        PATTERNS, QUERIES_, PAIRS, ("exact", EXACT), ("fuzz", fuzzy(0.92)),
        select="""SELECT * FROM exact UNION ALL SELECT * FROM fuzz WHERE fingerprint NOT IN (SELECT fingerprint FROM exact)
UNION ALL SELECT query_id, fingerprint, NULL, 0.0::DOUBLE, 'none' FROM qs WHERE fingerprint NOT IN (SELECT fingerprint FROM exact UNION ALL SELECT fingerprint FROM fuzz)""",
    ),
    "fitness_score": with_(PATTERNS, select=f"SELECT pattern_id, {recency('last_used_at')} AS recency, {r4('(CASE WHEN use_count > 0 THEN success_count::DOUBLE / use_count ELSE 0 END) * 0.6 + avg_savings * 0.3 + (' + recency('last_used_at') + ') * 0.1')} AS fitness FROM pats"),
    "fitness_totals": with_(
        USES,
        select=f"""SELECT fingerprint, use_count, success_count, a AS avg_savings, {r4(f"success_count::DOUBLE / use_count * 0.6 + a * 0.3 + ({recency('l')}) * 0.1")} AS fitness_score FROM (
  SELECT fingerprint, count(*) AS use_count, count(*) FILTER (success) AS success_count, {r4('sum(savings::DECIMAL(20,6))::DOUBLE / count(*)')} AS a, max(used_at) AS l FROM uses GROUP BY fingerprint)""",
    ),
    "fitness_running": with_(
        USES,
        select=f"""SELECT fingerprint, use_id, use_count, success_count, {r4('s / use_count')} AS avg_savings, {r4('success_count::DOUBLE / use_count * 0.6 + s / use_count * 0.3 + 0.1')} AS fitness_score FROM (
  SELECT fingerprint, use_id, count(*) OVER w AS use_count, count(*) FILTER (success) OVER w AS success_count, (sum(savings::DECIMAL(20,6)) OVER w)::DOUBLE AS s FROM uses WINDOW w AS (PARTITION BY fingerprint ORDER BY used_at, use_id ROWS UNBOUNDED PRECEDING))""",
    ),
    "fitness_update": with_(USES, NUMBERED, FOLD, select="SELECT * EXCLUDE (used_at, success) FROM fold"),
    "promote_deprecate": with_(
        USES, NUMBERED, FOLD,
        select="""SELECT fingerprint, use_count, status, low_run, status = 'probation' AND pu >= 3 AND sc > 0 AS should_promote,
  (status = 'probation' AND use_count >= 5 AND sc = 0) OR (status = 'active' AND ((low_run >= 3 AND fs < 0.68) OR date_sub('day', last, TIMESTAMP '2024-03-15 00:00:00') >= 180)) AS should_deprecate
FROM (SELECT fingerprint, max(use_count) AS use_count, arg_max(status, use_count) AS status, arg_max(probation_uses, use_count) AS pu, arg_max(success_count, use_count) AS sc, arg_max(fitness_score, use_count) AS fs, max(used_at) AS last,
  count(*) FILTER (back = run_back) AS low_run FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY use_count DESC) AS back,
    sum((fitness_score < 0.68)::INTEGER) OVER (PARTITION BY fingerprint ORDER BY use_count DESC ROWS UNBOUNDED PRECEDING) AS run_back FROM fold) GROUP BY fingerprint)""",
    ),
    "fitness_log": with_(USES, NUMBERED, FOLD, select="SELECT strftime(used_at, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(used_at) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS timestamp, use_id AS entry_id, fingerprint, use_count, fitness_score, avg_savings AS token_savings_pct, success FROM fold"),
    "pattern_index": with_(PATTERNS, select=f"SELECT pattern_id, fingerprint, upper(left(status, 1)) || substring(status, 2) AS status, {r4('fitness_score', 2)} AS fitness, use_count, coalesce(strftime(last_used_at, '%Y-%m-%d'), '—') AS last_used FROM pats"),
    "pattern_totals": with_(PATTERNS, select="SELECT status, count(*) AS patterns, sum(use_count)::BIGINT AS uses FROM pats GROUP BY status"),
    "validate_findings": with_(
        FINDINGS, FOUND_JSON,
        select="""SELECT repo_id, ord, severity, dimension, description, file, CASE WHEN ord % 2 = 0 AND ord % 4 <> 0 THEN ord % 100 ELSE 0 END::DOUBLE AS line_start, 0.0::DOUBLE AS line_end,
  CASE WHEN ord % 5 = 0 THEN 'see' ELSE '' END AS detail, '' AS fix, CASE WHEN ord % 3 = 0 THEN 7.5 ELSE 0 END::DOUBLE AS deduction FROM found_json WHERE ok""",
    ),
    "validate_dimensions": "SELECT c_custkey AS report_id, 'Security' AS dimension, 'B' AS grade, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 101 ELSE 0 END::DOUBLE AS score, c_custkey % 3 <> 0 AS active FROM customer WHERE c_custkey % 7 <> 0",
    "validate_uncertain": "SELECT c_custkey AS report_id, 'f' || c_custkey AS file, 0.0::DOUBLE AS line_start, 0.0::DOUBLE AS line_end, CASE WHEN c_custkey % 2 = 0 THEN 't' ELSE '' END AS trigger, CASE WHEN c_custkey % 2 = 0 THEN 55 ELSE 0 END::DOUBLE AS confidence_pct, '' AS recommended_action FROM customer WHERE c_custkey % 6 <> 0",
    "severity_filter": with_(FINDINGS, select="SELECT repo_id, ord, severity FROM findings WHERE severity = 'P0'"),
    "dimension_score": with_(FINDINGS, SCORES, select=f"SELECT *, {GRADE.format('score')} AS grade FROM scores"),
    "overall_score": with_(
        FINDINGS, SCORES,
        select=f"""SELECT repo_id, s AS overall_score, {GRADE.format('s')} AS overall_grade FROM (SELECT repo_id, coalesce(floor(CASE WHEN bool_or(active AND dimension = 'Compliance') THEN sum({_W1} * score) FILTER (active) / nullif(sum({_W1}) FILTER (active), 0)
  ELSE sum({_W2} * score) FILTER (active) / nullif(sum({_W2}) FILTER (active), 0) END + 0.5), 100)::BIGINT AS s FROM (SELECT *, (dimension <> 'Compliance' OR {_N} % 2 = 0) AND {_N} % 50 <> 0 AS active FROM scores) GROUP BY repo_id)""",
    ),
    "letter_grade": f"SELECT c_custkey, c_custkey % 101 AS score, {GRADE.format('c_custkey % 101')} AS grade FROM customer",
    "severity_counts": with_(
        FINDINGS,
        select="""SELECT *, array_to_string(list_filter([CASE WHEN p0 > 0 THEN p0 || ' P0' END, CASE WHEN p1 > 0 THEN p1 || ' P1' END, CASE WHEN p2 > 0 THEN p2 || ' P2' END, CASE WHEN p3 > 0 THEN p3 || ' P3' END], lambda x: x IS NOT NULL), ', ') AS label FROM (
  SELECT repo_id, dimension, count(*) FILTER (severity = 'P0') AS p0, count(*) FILTER (severity = 'P1') AS p1, count(*) FILTER (severity = 'P2') AS p2, count(*) FILTER (severity = 'P3') AS p3 FROM findings GROUP BY ALL)""",
    ),
    "findings_by_severity": with_(FINDINGS, select="SELECT repo_id, severity, ord, deduction, row_number() OVER (PARTITION BY repo_id, severity ORDER BY deduction DESC, ord) AS position FROM findings"),
    "sanitize_text": with_(FINDINGS, select=f"SELECT doc_id, sha256({clean('text')}) AS clean_hash FROM documents UNION ALL SELECT -ord - 1, {clean('description')} FROM findings"),
    "content_fence": with_(FINDINGS, select=f"SELECT ord, 'raw' AS form, {fence(chr(39) + chr(123) + chr(34) + 'file' + chr(34) + ':' + chr(34) + chr(39) + ' || file || description')} AS rule FROM findings UNION ALL SELECT ord, 'clean', {fence(clean('description'))} FROM findings"),
    "gap_frequency": with_(
        SIGHTINGS, ("ranked", "SELECT *, row_number() OVER (PARTITION BY fingerprint, dimension, gap ORDER BY use_no) AS n FROM sightings"),
        select=f"""SELECT * EXCLUDE (n) FROM (WITH RECURSIVE f AS (SELECT *, {r4('1.0::DOUBLE / use_no')} AS frequency FROM ranked WHERE n = 1
  UNION ALL SELECT r.*, {r4('(f.frequency * (r.use_no - 1) + 1) / r.use_no')} FROM f JOIN ranked r ON r.fingerprint = f.fingerprint AND r.dimension = f.dimension AND r.gap = f.gap AND r.n = f.n + 1) SELECT * FROM f)""",
    ),
    "gap_frequency_total": with_(SIGHTINGS, select=f"SELECT fingerprint, dimension, gap, count(*) AS sightings, {r4('1 - product((use_no - 1)::DOUBLE / use_no)')} AS frequency FROM sightings GROUP BY ALL"),
    "merge_gaps": with_(FINDINGS, GAPS, select="SELECT * FROM gaps"),
    "top_gaps": with_(FINDINGS, GAPS, select="SELECT *, (row_number() OVER (PARTITION BY fingerprint ORDER BY frequency DESC, dimension, gap))::INTEGER AS gap_rank FROM gaps QUALIFY gap_rank <= 3"),
    "learn_pattern": with_(
        PATTERNS, QUERIES_,
        select=f"""SELECT fingerprint, coalesce(pattern_id, left(sha256(fingerprint), 12)) AS pattern_id, CASE WHEN status = 'active' OR pu >= 3 THEN 'active' ELSE 'probation' END AS status, n AS use_count, pu AS probation_uses, sc AS success_count,
  {r4('sv')} AS avg_savings, {r4('sc::DOUBLE / n * 0.6 + sv * 0.3 + 0.1')} AS fitness_score, fitness_score AS history_score, use_count AS history_use_count
FROM (SELECT *, coalesce(use_count, 0) + more AS n, coalesce(probation_uses, 0) + more AS pu, coalesce(success_count, 0) + more AS sc,
    list_reduce(list_prepend(coalesce(avg_savings, 0.0)::DOUBLE, range(1, more + 1)::DOUBLE[]), lambda a, i: (a * (coalesce(use_count, 0) + i - 1) + least(0.8, a * 1.05)) / (coalesce(use_count, 0) + i)) AS sv
  FROM (SELECT fingerprint, count(*) AS more FROM qs GROUP BY fingerprint) LEFT JOIN (SELECT * FROM pats QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY store_ord) = 1) USING (fingerprint))""",
    ),
    "learned_document": with_(
        SIGHTINGS,
        ("had", "SELECT 'u' || c_custkey AS fingerprint, c_custkey % 9 + 1 AS u, (c_custkey % 97) / 97.0::DOUBLE AS a, (c_custkey % 40) / 40.0::DOUBLE AS f FROM customer WHERE c_custkey % 2 = 0"),
        ("learned", """SELECT *, list_reduce(list_prepend(coalesce(a, 0.0)::DOUBLE, range(1, more + 1)::DOUBLE[]), lambda x, i: (x * (coalesce(u, 0) + i - 1) + least(0.8, x * 1.05)) / (coalesce(u, 0) + i)) AS sv, coalesce(u, 0) + more AS n
  FROM (SELECT 'u' || user_id AS fingerprint, count(*) AS more FROM events GROUP BY ALL) LEFT JOIN had USING (fingerprint)"""),
        ("kept", "SELECT fingerprint, 'Security' AS dimension, 'error' AS gap, 'P2' AS severity, f AS frequency FROM had UNION ALL SELECT fingerprint, 'Testability', 'no tests', 'P3', 0.25::DOUBLE FROM had"),
        ("now_seen", "SELECT fingerprint, dimension, gap, product((use_no + 8)::DOUBLE / (use_no + 9)) AS missed FROM sightings GROUP BY ALL"),
        ("gaps", f"""SELECT fingerprint, dimension, gap, coalesce(k.severity, 'P1') AS severity, CASE WHEN missed IS NULL THEN frequency ELSE {r4('1 - (1 - coalesce(frequency, 0.0)) * missed')} END AS frequency
  FROM kept k FULL JOIN now_seen USING (fingerprint, dimension, gap)"""),
        select=f"""SELECT fingerprint, CASE WHEN more >= 3 THEN 'active' ELSE 'probation' END AS status, n AS use_count, {r4('sv')} AS avg_savings, {r4('0.6 + sv * 0.3 + 0.1')} AS fitness_score,
  (CASE WHEN u IS NULL THEN 0 ELSE 2 END)::BIGINT AS history_entries, CASE WHEN c_custkey IS NOT NULL THEN 'unit tests' || CASE WHEN c_custkey % 50 = 0 THEN ', ask root@example.com' ELSE '' END END AS test_pattern,
  coalesce(c_custkey % 50 = 0, false) AS is_rejected, dimension, gap, severity, frequency
FROM learned JOIN gaps USING (fingerprint) LEFT JOIN (SELECT 'u' || c_custkey AS fingerprint, c_custkey FROM customer) USING (fingerprint)""",
    ),
    "stack_summary": """SELECT 'repo-' || c_custkey AS repo_id, 'server: starts [source-file] | cli: starts [source-file]' AS entry_points,
  CASE WHEN c_custkey = 0 THEN 'No layer structure identified' ELSE 'api: handles api at [location] → data: handles data at [location]' END AS layers,
  CASE WHEN c_custkey % 5 > 0 THEN 'jwt + session in [source-file]' END AS auth_pattern, CASE WHEN c_custkey % 3 <> 0 THEN 'PostgreSQL Redis' || CASE WHEN c_custkey % 2 = 0 THEN ' with Prisma' ELSE '' END END AS db_pattern,
  'unit tests in [path]' AS test_pattern, CASE WHEN c_custkey % 4 = 0 THEN 'Kubernetes' || CASE WHEN c_custkey % 7 <> 0 THEN ' with Docker, Make' ELSE '' END WHEN c_custkey % 7 <> 0 THEN 'Docker, Make' END AS infra_pattern FROM customer""",
    "token_cost": f"""SELECT conv_id, model, approach, input_tokens, output_tokens, (input_tokens * i + output_tokens * o) / 1000000 AS cost_usd FROM (
  SELECT conv_id, n AS input_tokens, ceil(n * 0.3::DOUBLE)::BIGINT AS output_tokens FROM (SELECT conv_id, sum(ceil(length(text) / 4.0))::BIGINT AS n FROM conversations GROUP BY conv_id)), {_PRICES} p(model, i, o, approach)""",
    "dense_tokens": "SELECT conv_id, sum(ceil(length(text) / 3.0))::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "hash_embed": facts(f"SELECT doc_id, list_transform(w, lambda x: x / n) AS v FROM (SELECT doc_id, w, {_NORM} AS n FROM (SELECT doc_id, {_RAW_HASH} AS w FROM documents))", "doc_id"),
    "normalize_dim": facts(f"SELECT vec_id, list_transform(w, lambda x: x / n) AS v FROM (SELECT vec_id, w, {_NORM} AS n FROM (SELECT vec_id, list_concat(embedding::DOUBLE[], list_transform(range(0, 1536 - len(embedding)), lambda i: 0.0::DOUBLE)) AS w FROM embeddings))", "vec_id"),
    "normalize_dim_down": facts(f"SELECT vec_id, list_transform(w, lambda x: x / n) AS v FROM (SELECT vec_id, w, {_NORM} AS n FROM (SELECT vec_id, {_DOWN} AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))", "vec_id"),
}
