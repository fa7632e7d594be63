"""Oracle SQL of ``bindings.q_io``: what must be read back or come out of a stream."""

from __future__ import annotations

from bindings.oracles.common import PII_TEXTS, with_
from bindings.oracles.files import ORACLES as FILE_ORACLES
from bindings.oracles.patterns import FOLD, NUMBERED, PATTERNS, USES, fp
from bindings.oracles.pii import BASE, FULL, HASHED, KEPT, ORDERED, PATTERNS as PII_PATTERNS, RAW, SCRUBBED

DOCS_ONLY = (PII_TEXTS[0], "SELECT doc_id, text FROM documents")
ON_DOCS = (DOCS_ONLY, *BASE[1:])

STORE = (
    "store",
    """SELECT fingerprint, arg_max({'p': pattern_id, 's': status, 'u': uses, 'f': fitness_score}, {'t': stamp, 'p': pattern_id}) AS d FROM (
  SELECT *, use_count + (store_ord % 2 = 0)::INTEGER AS uses, store_ord % 7 + CASE WHEN store_ord % 2 = 0 THEN 24 ELSE 0 END AS stamp FROM pats) GROUP BY fingerprint""",
)
USER_RAW = (
    "raw",
    RAW[1] + f""" UNION ALL SELECT doc_id, 22 AS ord, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
  's': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::INTEGER, 'm': h[i]}}), recursive := true)
FROM (SELECT doc_id, string_split_regex(text, '\\b[0-9a-f]{{40}}\\b') g, regexp_extract_all(text, '\\b[0-9a-f]{{40}}\\b', 0) h FROM pii_texts WHERE regexp_matches(text, '\\b[0-9a-f]{{40}}\\b'))""",
)
# the user's row sorts first; among equal starts confidence decides before the order does
USER_PATTERNS = ("patterns", PII_PATTERNS[1] + " UNION ALL SELECT 22, 'user-hex-token', 'SECRET', 'API_KEY', 'HIGH', 99, NULL, NULL")

ORACLES = {
    "scan_and_read_files": "SELECT 'source=docs-' || source AS repo_id, sum(strlen(text) + 1)::BIGINT AS bytes, sum(length(text) + 1)::BIGINT AS chars, 0::BIGINT AS binary_files FROM documents GROUP BY source",
    "scan_paths": "SELECT 'host=' || regexp_extract(url, '^https?://([^/?#]*)', 1) AS repo_id, sum(strlen(html) + 1)::BIGINT AS bytes FROM pages GROUP BY ALL",
    "read_pattern_store": with_(PATTERNS, STORE, select="SELECT d.p AS pattern_id, fingerprint, d.s AS status, d.u AS use_count, d.f AS fitness_score FROM store"),
    "upsert_pattern": with_(PATTERNS, STORE, select="SELECT d.s AS status, count(*) AS patterns, sum(d.u)::BIGINT AS uses FROM store GROUP BY d.s"),
    "get_pattern": with_(PATTERNS, STORE, select=f"SELECT fingerprint, d.u AS use_count, 1::INTEGER AS history FROM store WHERE fingerprint = (SELECT {fp('k * 3')} FROM (SELECT max(p_partkey) AS k FROM part))"),
    "attestation_files": with_(*BASE, select="SELECT doc_id AS chain_id, count(*) AS entries, true AS valid, NULL::VARCHAR AS first_error FROM full_hits GROUP BY doc_id"),
    "append_fitness_log": with_(USES, select="SELECT fingerprint, count(*) AS entries, count(*) AS use_count, count(*) FILTER (success) AS successes FROM uses GROUP BY fingerprint"),
    "export_facts_json": FILE_ORACLES["file_counts"],
    "user_patterns": with_(PII_TEXTS, USER_PATTERNS, USER_RAW, ORDERED, KEPT, FULL, select="SELECT pattern_id, count(*) AS hits FROM full_hits GROUP BY pattern_id"),
    "stream_scrub": with_(*ON_DOCS, SCRUBBED, HASHED, select="SELECT doc_id, scrubbed, payload_hash, hits FROM hashed"),
    "stream_fitness_ordered": with_(USES, NUMBERED, FOLD, select="SELECT * EXCLUDE (used_at, success) FROM fold WHERE used_at <= (SELECT max(ts) FROM events) - INTERVAL 5 DAY"),
    "stream_fitness": with_(USES, NUMBERED, FOLD, select="SELECT * EXCLUDE (used_at, success) FROM fold"),
    "stream_attest": with_(*ON_DOCS, select="SELECT doc_id AS chain_id, count(*) AS entries, true AS valid, NULL::VARCHAR AS first_error FROM full_hits GROUP BY doc_id"),
    "stream_attest_by_source": with_(*ON_DOCS, select="SELECT coalesce(source, '') AS chain_id, count(*) AS entries, true AS valid, NULL::VARCHAR AS first_error FROM full_hits JOIN documents USING (doc_id) GROUP BY ALL"),
}
