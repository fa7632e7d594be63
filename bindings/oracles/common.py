"""DuckDB forms of the relations in ``bindings.relations``, as WITH members."""

from __future__ import annotations

from bindings import templates as t


def lit(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def strings(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def slist(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def fill(template: str, pairs: dict[str, str]) -> str:
    for name, expr in pairs.items():
        template = f"replace({template}, '{{{name}}}', ({expr})::VARCHAR)"
    return template


def with_(*members: tuple[str, str], select: str) -> str:
    seen: dict[str, str] = {}
    for name, body in members:
        seen.setdefault(name, body)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in seen.items()) + "\n" + select


PII_TEXTS = (
    "pii_texts",
    "SELECT doc_id, text FROM documents UNION ALL SELECT c_custkey + 1000000000, "
    + fill("tpl", {"k": "lpad((c_custkey % 100000)::VARCHAR, 5, '0')", "k3": "lpad((c_custkey % 1000)::VARCHAR, 3, '0')"})
    + f" FROM customer JOIN {values(enumerate(t.NOTES))} f(form, tpl) ON c_custkey % {len(t.NOTES)} = form",
)

PROJECT_FILES = (
    "project_files",
    "SELECT 'repo-' || c_custkey AS repo_id, p.path, "
    + fill("p.tpl", {"id": "c_custkey", "nat": "c_nationkey"})
    + f" AS content FROM customer JOIN {values(t.project_rows())} p(combo, path, tpl) ON c_custkey % 20 = p.combo",
)

_SLOTS = {
    "o": "l_orderkey", "n": "l_linenumber", "prev": "CASE WHEN l_linenumber = 1 THEN 2 ELSE l_linenumber - 1 END",
    "nxt": "l_linenumber + 1", "part": "part", "supp": "supp",
}
MODULE_FILES = (
    "module_files",
    "SELECT 'repo-' || o_custkey AS repo_id, " + fill("m.path", _SLOTS) + " AS path, " + fill("m.tpl", _SLOTS)
    + " AS content FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) part, min(l_suppkey) supp FROM lineitem GROUP BY ALL) l "
    + "JOIN orders ON l_orderkey = o_orderkey "
    + f"JOIN {values(t.module_rows())} m(combo, path, tpl) ON m.combo = (o_custkey % 5) * 4 "
    + "+ CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN part % 4 = 0 THEN 1 ELSE 0 END",
)

REPO_FILES = ("repo_files", "SELECT * FROM project_files UNION ALL SELECT * FROM module_files")

TEXT_FILES = (
    "text_files",
    "SELECT 'docs-' || source AS repo_id, 'docs/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents "
    "UNION ALL SELECT 'site-' || regexp_extract(url, '^https?://([^/?#]*)', 1), "
    "'www/' || page_id || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), html FROM pages",
)
CORPUS_FILES = ("corpus_files", "SELECT * FROM repo_files UNION ALL SELECT * FROM text_files")

REPO = (PROJECT_FILES, MODULE_FILES, REPO_FILES)
CORPUS = (*REPO, TEXT_FILES, CORPUS_FILES)
