"""Oracle SQL of ``bindings.q_pii``."""

from __future__ import annotations

from bindings.oracles.common import CORPUS, PII_TEXTS, lit, slist, strings, values, with_
from factloom import signals
from factloom.functions.regex import WS_CHARS, to_re2
from factloom.operators.attest import ENTRY_FIELDS

P = signals.PII_PATTERNS
RX = [to_re2(p.regex, p.flags) for p in P]

PATTERNS = (
    "patterns",
    "SELECT * FROM " + values(
        (i, p.pattern_id, p.category, p.pii_type, p.confidence, p.confidence_pct, p.hipaa_identifier, p.safe_harbor_item)
        for i, p in enumerate(P, 1)
    ) + " t(ord, pattern_id, category, pii_type, confidence, confidence_pct, hipaa_identifier, safe_harbor_item)",
)
RAW = (
    "raw",
    " UNION ALL ".join(
        f"""SELECT doc_id, {n} AS ord, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
  's': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::INTEGER,
  'm': h[i]}}), recursive := true)
FROM (SELECT doc_id, string_split_regex(text, {lit(rx)}) g, regexp_extract_all(text, {lit(rx)}, 0) h FROM pii_texts
      WHERE regexp_matches(text, {lit(rx)}))"""
        for n, rx in enumerate(RX, 1)
    ),
)
ORDERED = (
    "ordered",
    "SELECT r.*, (s + length(m))::INTEGER AS e, row_number() OVER (PARTITION BY doc_id ORDER BY s, -confidence_pct, r.ord) AS rn "
    "FROM raw r JOIN patterns USING (ord)",
)
KEPT = (
    "kept",
    """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s)::INTEGER AS seq FROM (
  WITH RECURSIVE walk AS (
    SELECT *, true AS keep, e AS last_end FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.*, o.s >= w.last_end, CASE WHEN o.s >= w.last_end THEN o.e ELSE w.last_end END
    FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1
  ) SELECT doc_id, ord, s, e, m FROM walk WHERE keep)""",
)
FULL = (
    "full_hits",
    """SELECT k.*, p.* EXCLUDE (ord), left(sha256(doc_id || '|text|' || s || '|' || pattern_id), 32) AS ref_id,
  '[' || category || ':' || pii_type || ':ref:' || left(sha256(doc_id || '|text|' || s || '|' || pattern_id), 32) || ':CONF:' || confidence
  || CASE WHEN confidence IN ('UNCERTAIN', 'LOW') THEN ':REVIEW_REQUIRED]' ELSE ']' END AS token
FROM kept k JOIN patterns p USING (ord)""",
)
SCRUBBED = (
    "scrubbed",
    """SELECT t.doc_id, coalesce(r.head || substring(t.text, r.tail + 1), t.text) AS scrubbed, coalesce(r.hits, 0) AS hits
FROM pii_texts t LEFT JOIN (
  SELECT doc_id, string_agg(substring(text, prev + 1, s - prev) || token, '' ORDER BY s) AS head, max(e) AS tail, count(*) AS hits
  FROM (SELECT f.*, text, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM full_hits f JOIN pii_texts USING (doc_id))
  GROUP BY doc_id) r USING (doc_id)""",
)
BASE = (PII_TEXTS, PATTERNS, RAW, ORDERED, KEPT, FULL)
HASHED = (
    "hashed",
    "SELECT *, 'sha256:' || sha256(to_json({'text': scrubbed})::VARCHAR) AS payload_hash FROM scrubbed",
)

_SQL_OF = {
    "entry_id": "f.ref_id", "chain_seq": "f.seq", "detected_at": "'2024-01-01T00:00:00.000Z'", "analyst_id": "'analyst'",
    "repo": "'documents'", "repo_commit": "'HEAD'", "file": "'[payload:' || f.doc_id || ']'", "line_start": "1", "line_end": "1",
    "col_start": "f.s", "col_end": "f.e", "pii_category": "f.category", "pii_type": "f.pii_type",
    "hipaa_identifier": "f.hipaa_identifier", "hipaa_safe_harbor_item": "f.safe_harbor_item",
    "scrub_confidence": "f.confidence", "scrub_action": "'REPLACED_WITH_TOKEN'", "token_placed": "f.token",
    "payload_hash": "h.payload_hash",
}


def _json(prev: str, this: str | None = None) -> str:
    parts = [f"'{js}': {prev if col == 'prev_hash' else _SQL_OF[col]}" for js, col, _ in ENTRY_FIELDS]
    if this:
        parts.append(f"'thisHash': {this}")
    return "to_json({" + ", ".join(parts) + "})::VARCHAR"


def _hash(x: str) -> str:
    return f"'sha256:' || sha256({x})"


def _links(prev: str) -> str:
    this = _hash(_json(prev))
    return f"{prev} AS prev_hash, {this} AS this_hash, {_hash(_json(prev, this))} AS next_prev"


_GENESIS = lit("0" * 64)
_FROM = "full_hits f JOIN hashed h ON f.doc_id = h.doc_id"
CHAIN = (
    "chain",
    f"""WITH RECURSIVE c AS (
  SELECT f.doc_id, f.seq, {_links(_GENESIS)} FROM {_FROM} WHERE f.seq = 1
  UNION ALL
  SELECT f.doc_id, f.seq, {_links('c.next_prev')} FROM c JOIN {_FROM} ON f.doc_id = c.doc_id AND f.seq = c.seq + 1
) SELECT f.doc_id AS chain_id, """
    + ", ".join(
        ("c.prev_hash" if col == "prev_hash" else _SQL_OF[col]) + f" AS {col}" for _, col, _ in ENTRY_FIELDS
    )
    + f", c.this_hash FROM c JOIN {_FROM} ON f.doc_id = c.doc_id AND f.seq = c.seq",
)

# ---- one chain per source
SOURCED = (
    "sourced",
    """SELECT f.*, coalesce(d.source, CASE WHEN d.doc_id IS NULL THEN 'notes' ELSE '' END) AS chain,
  row_number() OVER (PARTITION BY coalesce(d.source, CASE WHEN d.doc_id IS NULL THEN 'notes' ELSE '' END) ORDER BY f.doc_id, f.seq) AS n
FROM full_hits f LEFT JOIN documents d USING (doc_id)""",
)


def _source_links(prev: str) -> str:
    this = _hash(_json(prev)).replace("f.seq", "f.n")
    return f"{prev} AS prev_hash, {this} AS this_hash, {_hash(_json(prev, this)).replace('f.seq', 'f.n')} AS next_prev"


_SOURCED_FROM = "sourced f JOIN hashed h ON f.doc_id = h.doc_id"
SOURCE_CHAIN = (
    "source_chain",
    f"""WITH RECURSIVE c AS (
  SELECT f.chain, f.n, f.ref_id, f.doc_id, {_source_links(_GENESIS)} FROM {_SOURCED_FROM} WHERE f.n = 1
  UNION ALL
  SELECT f.chain, f.n, f.ref_id, f.doc_id, {_source_links('c.next_prev')} FROM c JOIN {_SOURCED_FROM} ON f.chain = c.chain AND f.n = c.n + 1
) SELECT chain AS chain_id, n AS chain_seq, ref_id AS entry_id, '[payload:' || doc_id || ']' AS file, prev_hash, this_hash FROM c""",
)

# ---- line signals
NAME = "regexp_extract(path, '([^/]*)$', 1)"


def ext_of(name: str) -> str:
    return f"lower(regexp_extract({name}, '(?s:.)(\\.[^.]*)$', 1))"


IN_SCOPE = (
    f"NOT ({ext_of(NAME)} IN {strings(signals.PII_SKIP_EXTENSIONS)} OR path LIKE '%.min.js' OR path LIKE '%.min.css' OR "
    + " OR ".join(f"contains(path, {lit(x)})" for x in signals.PII_SKIP_FRAGMENTS) + ")"
)
_STRIPPED = f"trim(line, {lit(WS_CHARS)})"
_COMMENT = " OR ".join(f"starts_with({_STRIPPED}, {lit(p)})" for p in signals.COMMENT_PREFIXES)
_HINT = (
    f"CASE WHEN {_COMMENT} THEN NULL "
    + " ".join(f"WHEN regexp_matches(line, {lit(to_re2(rx, 'i'))}) THEN {lit(h)}" for rx, h in signals.LINE_SIGNALS)
    + " END"
)
LINES = (
    "hinted",
    f"""SELECT * FROM (SELECT repo_id, path, line_no, {_HINT} AS hint FROM (
  SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no
  FROM corpus_files WHERE {IN_SCOPE})) WHERE hint IS NOT NULL""",
)
ISLANDS = (
    "islands",
    """SELECT repo_id, path, min(line_no) AS line_start, max(line_no) AS line_end, any_value(hint) AS hint, island::INTEGER AS island
FROM (SELECT *, sum(fresh) OVER (PARTITION BY repo_id, path ORDER BY line_no) AS island FROM (
  SELECT *, CASE WHEN lag(hint) OVER w = hint AND line_no - lag(line_no) OVER w <= 3 THEN 0 ELSE 1 END AS fresh
  FROM hinted WINDOW w AS (PARTITION BY repo_id, path ORDER BY line_no)))
GROUP BY repo_id, path, island""",
)

# ---- JSON payloads: one note text at two places of a payload, each with reference ids of its own
JSON_PLACES = ("root.body.text", "root.body.list[1][0]")
JSON_TOKENS = (14, 24)


def _scrubbed_at(name: str, path: str, token: int) -> tuple[str, str]:
    ref = f"left(sha256(doc_id || '|{path}#{token}|' || s || '|' || pattern_id), 32)"
    return (
        name,
        f"""SELECT t.doc_id, coalesce(r.head || substring(t.text, r.tail + 1), t.text) AS scrubbed, coalesce(hits, 0) AS hits, places
FROM pii_texts t LEFT JOIN (
  SELECT doc_id, string_agg(substring(text, prev + 1, s - prev) || replace(token, ref_id, {ref}), '' ORDER BY s) AS head, max(e) AS tail, count(*) AS hits,
    string_agg('{path}@' || s, ' ' ORDER BY s) AS places
  FROM (SELECT f.*, text, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM full_hits f JOIN pii_texts USING (doc_id))
  GROUP BY doc_id) r USING (doc_id)""",
    )


_NOTE_JSON = (
    "to_json({'id': t.doc_id, 'name': t.text, 'body': {'text': a.scrubbed, 'list': [['x'], [b.scrubbed, 'y']], 'none': NULL::VARCHAR}, 'n': 1.5::DOUBLE, 'ok': true})::VARCHAR"
)
_EVENT_JSON = (
    """'{"type":"' || event_type || '","props":' || props || ',"notes":["user ' || user_id || '",{"path":"/e/' || event_id || '","tags":["' || event_type || '",["deep",1,null,true]]}]}'"""
)

ORACLES = {
    "counts_by_type": with_(*BASE, select="SELECT category, pii_type, count(*) AS hits, sum(length(m))::BIGINT AS chars_replaced FROM full_hits GROUP BY ALL"),
    "detect_pii": with_(PII_TEXTS, PATTERNS, RAW, ORDERED, select="SELECT doc_id, pattern_id, category, pii_type, confidence, confidence_pct, safe_harbor_item, s AS start_pos, e AS end_pos FROM ordered JOIN patterns USING (ord)"),
    "resolve_overlaps": with_(*BASE, select="SELECT doc_id, seq, pattern_id, s AS start_pos, e AS end_pos, confidence, confidence_pct FROM full_hits"),
    "build_token": with_(*BASE, select="SELECT doc_id, seq, ref_id, token FROM full_hits"),
    "scrub_value": with_(*BASE, SCRUBBED, HASHED, select="SELECT doc_id, scrubbed, payload_hash, hits FROM hashed"),
    "structural_gate": with_(
        *BASE, SCRUBBED,
        select="""SELECT s.doc_id, 'name' AS field, t.text AS scrubbed, 0::BIGINT AS hits FROM scrubbed s JOIN pii_texts t USING (doc_id) WHERE s.doc_id % 2 = 0
UNION ALL SELECT doc_id, 'note', replace_refs, hits FROM (
  SELECT t.doc_id, coalesce(r.head || substring(t.text, r.tail + 1), t.text) AS replace_refs, coalesce(r.hits, 0) AS hits
  FROM pii_texts t LEFT JOIN (
    SELECT doc_id, string_agg(substring(text, prev + 1, s - prev) || replace(token, ref_id, left(sha256(doc_id || '|note|' || s || '|' || pattern_id), 32)), '' ORDER BY s) AS head,
      max(e) AS tail, count(*) AS hits
    FROM (SELECT f.*, text, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM full_hits f JOIN pii_texts USING (doc_id))
    GROUP BY doc_id) r USING (doc_id) WHERE t.doc_id % 2 <> 0)""",
    ),
    "detection_counts": with_(*BASE, select="SELECT doc_id, count(*) FILTER (category = 'PHI') AS phi_count, count(*) FILTER (category = 'PII') AS pii_count, count(*) FILTER (category = 'SECRET') AS secret_count FROM pii_texts LEFT JOIN full_hits USING (doc_id) GROUP BY doc_id"),
    "uncertain_detections": with_(*BASE, select="SELECT doc_id, ref_id AS entry_id, 'Pattern: ' || pattern_id || ' matched \"' || left(m, 40) || '\"' AS trigger, confidence, confidence_pct, true AS is_approximate_range, false AS marked_reviewed FROM full_hits WHERE confidence IN ('UNCERTAIN', 'LOW')"),
    "purity_check": with_(
        PII_TEXTS, PATTERNS, RAW, ORDERED,
        (
            "descriptions",
            "SELECT * FROM " + values((i, p.description) for i, p in enumerate(P, 1)) + " t(ord, description)",
        ),
        select="""SELECT doc_id, description AS first_pattern, s AS first_position, left(m, 60) || CASE WHEN length(m) > 60 THEN '…' ELSE '' END AS first_value
FROM ordered JOIN patterns USING (ord) JOIN descriptions USING (ord) WHERE confidence IN ('HIGH', 'MEDIUM')
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord, s) = 1""",
    ),
    "purity_after_scrub": with_(
        *BASE, SCRUBBED,
        select="SELECT count(*) FILTER (" + " OR ".join(
            f"regexp_matches(scrubbed, {lit(rx)})" for rx, p in zip(RX, P) if p.confidence in ("HIGH", "MEDIUM")
        ) + ") AS impure_texts, count(*) AS texts FROM scrubbed",
    ),
    "line_of_match": with_(*BASE, select="SELECT doc_id, s AS start_pos, (length(left(text, s)) - length(replace(left(text, s), chr(10), '')) + 1)::INTEGER AS line_no FROM full_hits JOIN pii_texts USING (doc_id)"),
    "attestation_chain": with_(*BASE, SCRUBBED, HASHED, CHAIN, select="SELECT * FROM chain"),
    "attestation_chain_by_source": with_(*BASE, SCRUBBED, HASHED, SOURCED, SOURCE_CHAIN, select="SELECT * FROM source_chain"),
    "verify_chain_by_source": with_(
        *BASE, SOURCED,
        select="""SELECT chain AS chain_id, count(*) AS entries, true AS valid, NULL::VARCHAR AS first_error FROM sourced GROUP BY chain
UNION ALL SELECT chain || '!', count(*), count(*) < 2, CASE WHEN count(*) >= 2 THEN 'Entry 2: thisHash tampered' END FROM sourced GROUP BY chain""",
    ),
    "verify_chain": with_(
        *BASE,
        select="""SELECT doc_id AS chain_id, count(*) AS entries, true AS valid, NULL::VARCHAR AS first_error FROM full_hits GROUP BY doc_id
UNION ALL SELECT -doc_id - 1, count(*), count(*) < 2, CASE WHEN count(*) >= 2 THEN 'Entry 2: thisHash tampered' END FROM full_hits GROUP BY doc_id""",
    ),
    "pii_candidate_lines": with_(*CORPUS, LINES, select="SELECT repo_id, path, line_no, hint FROM hinted"),
    "pii_scan_scope": with_(*CORPUS, select=f"SELECT repo_id, count(*) FILTER ({IN_SCOPE}) AS scanned, count(*) FILTER (NOT ({IN_SCOPE})) AS skipped FROM corpus_files GROUP BY repo_id"),
    "merge_pii_islands": with_(*CORPUS, LINES, ISLANDS, select="SELECT repo_id, path, island, line_start, line_end, hint FROM islands"),
    "phi_zones": with_(
        *CORPUS, LINES, ISLANDS,
        select="""SELECT repo_id, path, min(line_start) AS line_start, max(line_end) AS line_end, count(*) AS phi_field_count,
  array_to_string(list_transform(list_sort(list({'f': island, 'h': hint}) FILTER (first_of_hint))[1:3], lambda x: x.h), '; ') AS dev_note,
  (row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, path))::INTEGER AS zone_rank
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, hint ORDER BY island) = 1 AS first_of_hint FROM islands)
GROUP BY repo_id, path QUALIFY zone_rank <= 50""",
    ),
    "walk_string_leaves": f"""
SELECT payload_id, leaf_no::INTEGER AS leaf_no, json_path, field, value, NOT (field IN {strings(signals.STRUCTURAL_FIELDS)}) AS scrubbable FROM (
SELECT event_id AS payload_id, unnest([1, 2, 3, 4, 5]) AS leaf_no,
  unnest(['root.type', 'root.notes[0]', 'root.notes[1].path', 'root.notes[1].tags[0]', 'root.notes[1].tags[1][0]']) AS json_path,
  unnest(['type', 'notes', 'path', 'tags', 'tags']) AS field,
  unnest([event_type, 'user ' || user_id, '/e/' || event_id, event_type, 'deep']) AS value FROM events)""",
    # no event text holds anything to scrub
    "scrub_json": with_(
        *BASE, _scrubbed_at("at_text", JSON_PLACES[0], JSON_TOKENS[0]), _scrubbed_at("at_list", JSON_PLACES[1], JSON_TOKENS[1]),
        (
            "payloads",
            f"""SELECT t.doc_id AS payload_id, {_NOTE_JSON} AS scrubbed, a.hits + b.hits AS hits, concat_ws(' ', a.places, b.places) AS places
FROM pii_texts t JOIN at_text a USING (doc_id) JOIN at_list b USING (doc_id)
UNION ALL SELECT -event_id - 1, {_EVENT_JSON}, 0, '' FROM events""",
        ),
        select="SELECT payload_id, scrubbed, 'sha256:' || sha256(scrubbed) AS payload_hash, hits, places FROM payloads",
    ),
    "json_purity": with_(
        PII_TEXTS, PATTERNS, RAW, ORDERED,
        (
            "descriptions",
            "SELECT * FROM " + values((i, p.description) for i, p in enumerate(P, 1)) + " t(ord, description)",
        ),
        select=f"""SELECT doc_id AS payload_id, unnest({slist(JSON_PLACES)}) AS json_path, first_pattern, first_position, first_value FROM (
SELECT doc_id, description AS first_pattern, s AS first_position, left(m, 60) || CASE WHEN length(m) > 60 THEN '…' ELSE '' END AS first_value
FROM ordered JOIN patterns USING (ord) JOIN descriptions USING (ord) WHERE confidence IN ('HIGH', 'MEDIUM')
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord, s) = 1)""",
    ),
}
