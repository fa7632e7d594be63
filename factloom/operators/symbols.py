"""Declarations and imports of source files.

The scan works on the lines of one file inside its row (no explode, no shuffle); ``raw_imports`` gives the
exploded form that the graph operators use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.arrays import posexplode_once
from factloom.functions.regex import WS_CHARS, sql_literal, to_java

_R = signals.SYMBOL_REGEXES
_NONE = "cast(array() as array<string>)"


def _rx(pattern: str) -> str:
    return sql_literal(to_java(pattern))


def _any(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def _begins(*words: str) -> str:
    return _any([f"startswith(l, '{word}')" for word in words])


def _of_lines(wanted: str, value: str) -> str:
    """Nonempty values of the wanted lines, in line order.  ``wanted`` holds wherever ``value`` can give something; it compares bytes, so
    most lines meet no regex."""
    return f"filter(transform(filter(_lines, l -> {wanted}), l -> {value}), x -> x <> '')"


def _first(pattern: str, group: int = 1) -> str:
    return f"regexp_extract(l, {_rx(pattern)}, {group})"


def _hits(pattern: str, *words: str) -> str:
    """First match of every line that begins with one of ``words``."""
    return _of_lines(_begins(*words), _first(pattern))


def _either(one: str, other: str, *words: str) -> str:
    """Matches of two patterns that no line matches both."""
    return _of_lines(_begins(*words), f"concat({one}, {other})")


_SCRIPT, _PY, _GO, _JVM, _RUBY = (_R[k] for k in ("script", "python", "go", "jvm", "ruby"))

_VISIBLE = ("public", "private", "protected")

# Go lists its imports in blocks, which hold nothing else: a line "import (" begins one, the next line ")" ends it.  The text is cut at the
# first lines and the pieces behind them at the first of the others, so every piece is what lies inside a block and what lies after it.
_BLANK = r"[\t\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]*"


def _whole_line(body: str) -> str:
    return sql_literal(rf"(?<![^\n]){_BLANK}{body}{_BLANK}(?![^\n])")


_GO_PIECES = f"""CASE WHEN contains(content, 'import (') THEN
    transform(split(content, {_whole_line(r"import \(")}, -1), (piece, i) -> CASE WHEN i = 0 THEN array('', piece)
      ELSE split(piece, {_whole_line(r"\)")}, 2) END)
  WHEN content IS NOT NULL THEN array(array('', content)) END"""
_GO_OUTSIDE = "array_join(transform(_go, p -> coalesce(get(p, 1), '')), '\n')"
_GO_IMPORTS = f"""filter(flatten(transform(_go, p -> flatten(array(
    transform(filter(split(get(p, 0), '\n', -1), l -> contains(l, '"')), l -> {_first(_GO["block_import"])}),
    CASE WHEN contains(get(p, 1), 'import "') THEN transform(split(get(p, 1), '\n', -1), l -> regexp_extract(btrim(l, _ws), {_rx(_GO["import"])}, 1))
      ELSE {_NONE} END)))), x -> x <> '')"""

_SCRIPT_IMPORTS = f"""filter(flatten(transform(filter(_lines, l -> {_any([_begins("import", "export"), "contains(l, 'require')"])}),
    l -> CASE WHEN contains(l, 'require') THEN flatten(array(array({_first(_SCRIPT["import_from"])}), regexp_extract_all(l, {_rx(_SCRIPT["require"])}, 1)))
      ELSE array({_first(_SCRIPT["import_from"])}) END)), x -> x <> '')"""


def _case(script: str = _NONE, python: str = _NONE, go: str = _NONE, jvm: str = _NONE, ruby: str = _NONE) -> str:
    return f"""CASE WHEN language IN ('TypeScript', 'JavaScript') THEN {script} WHEN language = 'Python' THEN {python}
      WHEN language = 'Go' THEN {go} WHEN language IN ('Java', 'Kotlin') THEN {jvm} WHEN language = 'Ruby' THEN {ruby}
      ELSE {_NONE} END"""


_JVM_CLASSES = _hits(_JVM["class"], *_VISIBLE, "abstract", "class", "interface", "enum")
_DECORATORS = _hits(_R["decorator"], "@")
_LISTS = {
    "exports": _case(
        script=_hits(_SCRIPT["exports"], "export"),
        python=f"filter({_either(_first(_PY['function']), _first(_PY['class']), 'async', 'def', 'class')}, x -> NOT startswith(x, '_'))",
        go=f"filter({_either(_first(_GO['function']), _first(_GO['type']), 'func', 'type')}, x -> x rlike '^[A-Z]')",
        jvm=_JVM_CLASSES,
    ),
    "imports": _case(
        script=_SCRIPT_IMPORTS,
        python=_either(_first(_PY["import"], 1), _first(_PY["import"], 2), "import", "from"),
        go=_GO_IMPORTS,
        jvm=f"transform({_hits(_JVM['import'], 'import')}, x -> regexp_replace(x, '^([^;]*);', '$1'))",
        ruby=_hits(_RUBY["import"], "require"),
    ),
    "functions": _case(
        script=_either(_first(_SCRIPT["function"]), _first(_SCRIPT["arrow"]), "export", "async", "function", "const", "let"),
        python=_hits(_PY["function"], "async", "def"),
        go=_hits(_GO["function"], "func"),
        jvm=_hits(_JVM["method"], *_VISIBLE),
        ruby=_hits(_RUBY["function"], "def"),
    ),
    "classes": _case(
        script=_hits(_SCRIPT["class"], "export", "abstract", "class"), python=_hits(_PY["class"], "class"), go=_hits(_GO["type"], "type"),
        jvm=_JVM_CLASSES, ruby=_hits(_RUBY["class"], "class", "module"),
    ),
    "decorators": _case(script=_DECORATORS, python=_DECORATORS, jvm=_DECORATORS),
}
_DEFAULT = f"""CASE WHEN language IN ('TypeScript', 'JavaScript')
    THEN exists(filter(_lines, l -> {_begins("export", "module")}), l -> l RLIKE {_rx(_SCRIPT["default"])}) ELSE false END"""


def source_symbols(cat: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(repo_id, path, language, exports, imports, functions, classes, decorators, has_default_export), lists
    distinct in order of appearance; a report may cut them with ``caps`` (``signals.SYMBOL_CAPS``)."""
    src = cat.filter(F.col("extraction_type") == "source").select("repo_id", "path", "language", "content")
    # what lies outside the import blocks of a Go file, and all of any other
    text = f"CASE WHEN language = 'Go' THEN {_GO_OUTSIDE} ELSE content END"
    cut = src.select("repo_id", "path", "language", "content", F.expr(f"CASE WHEN language = 'Go' THEN {_GO_PIECES} END").alias("_go"), F.lit(WS_CHARS).alias("_ws"))
    lined = cut.selectExpr("repo_id", "path", "language", "_go", "_ws", f"transform(split({text}, '\n', -1), l -> btrim(l, _ws)) AS _lines")
    whole = {name: f"array_distinct({sql})" for name, sql in _LISTS.items()}
    lists = [f"slice({sql}, 1, {caps[name]}) AS {name}" if caps else f"{sql} AS {name}" for name, sql in whole.items()]
    return lined.selectExpr("repo_id", "path", "language", *lists, f"{_DEFAULT} AS has_default_export")


def raw_imports(symbols: DataFrame) -> DataFrame:
    """(repo_id, path, import_no, raw_import), distinct per file."""
    out = symbols.select("repo_id", "path", posexplode_once("imports").alias("i", "raw_import"))
    return out.select("repo_id", "path", (F.col("i") + 1).alias("import_no"), "raw_import")
