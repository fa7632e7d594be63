"""ECMAScript-flavoured regular expressions on Spark.

Signal tables in this library are written in the ECMAScript dialect.  ``to_java`` renders
one for Spark (java.util.regex) and ``to_re2`` for RE2 engines, so both mean the same thing:

* ``\\b`` is an ASCII boundary (Java's is Unicode-aware), written as a one-sided look-around
  where the neighbouring atom is known to be a word character, two-sided otherwise;
* ``\\s`` covers the Unicode spaces and U+FEFF;
* ``.`` stops at every ECMAScript line terminator; ``$`` is the end of the text only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.arrays import scan_sql

# characters stripped by a whitespace trim
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_CLASS = (
    r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
_DOT = r"[^\n\r\x{2028}\x{2029}]"
_ANY_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _render(pattern: str, flags: str, boundary) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    pattern = pattern.replace(r"[\s\S]", "\x00")
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i : i + 2]
        if ch == "\x00":
            out.append("(?s:.)")
        elif ch == "\\":
            i += 1
            if pair == r"\s":
                out.append(_WS_CLASS if in_class else f"[{_WS_CLASS}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{_WS_CLASS}]")
            elif pair == r"\b" and not in_class:
                out.append(boundary(i == 1, i + 1 == len(pattern)))
            elif pair == r"\/":
                out.append("/")
            else:
                out.append(pair)
        elif in_class:
            in_class = ch != "]"
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == ".":
            out.append(_DOT)
        elif ch == "$" and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    inline = "".join(f for f in flags if f in "im")
    return (f"(?{inline})" if inline else "") + "".join(out)


def to_java(pattern: str, flags: str = "", *, word_start: bool = True, word_end: bool = True) -> str:
    """Render for Spark.  ``word_start``/``word_end`` state that a boundary at the very start/end of
    the pattern touches a word-only atom, which allows the cheap one-sided form."""

    def boundary(at_start: bool, at_end: bool) -> str:
        if at_start and word_start:
            return r"(?<!\w)"
        if at_end and word_end:
            return r"(?!\w)"
        return _ANY_BOUNDARY

    return _render(pattern, flags, boundary)


def to_re2(pattern: str, flags: str = "") -> str:
    """Render for RE2, whose ``\\b`` is already ASCII."""
    return _render(pattern, flags, lambda *_: r"\b")


def any_word(words) -> str:
    """Regex for a choice of words, factored by common beginnings so that a position is tested letter by letter instead
    of word by word."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    ends = "" in heads
    branches = [head + any_word(tails) for head, tails in heads.items() if head]
    if not branches:
        return ""
    choice = branches[0] if len(branches) == 1 and not ends else "(?:" + "|".join(branches) + ")"
    return choice + "?" if ends else choice


def trim_ws(col: Column) -> Column:
    """Trim every ECMAScript whitespace character, not only blanks."""
    return F.btrim(col, F.lit(WS_CHARS))


def extract_groups(text: Column, java_regex: str, group: int = 1) -> Column:
    """All matches of one capture group, in text order; empty array when nothing matches."""
    return F.regexp_extract_all(text, F.lit(java_regex), F.lit(group))


def first_group(text: Column, java_regex: str, group: int = 1) -> Column:
    """Capture group of the first match, NULL when there is no match."""
    return F.when(text.rlike(java_regex), F.regexp_extract(text, java_regex, group))


def sql_literal(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN_TYPE = "struct<start_pos:int,end_pos:int,matched:string>"


def spans_sql(text: str, java_regex: str) -> str:
    """SQL text of :func:`match_spans`; ``text`` is SQL as well."""
    rx = sql_literal(java_regex)
    start = "s.state + length(x.`0`)"
    end = f"{start} + length(x.`1`)"
    pieces = f"filter(arrays_zip(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0)), p -> p.`1` IS NOT NULL)"
    found = scan_sql(pieces, "0", end, f"named_struct('start_pos', {start}, 'end_pos', {end}, 'matched', x.`1`)", SPAN_TYPE)
    return f"CASE WHEN {text} RLIKE {rx} THEN {found} ELSE cast(array() AS array<{SPAN_TYPE}>) END"


def match_spans(text: str, java_regex: str) -> Column:
    """``array<struct<start_pos:int, end_pos:int, matched:string>>`` for every match, in code points.

    ``text`` is a column name or SQL expression.  Offsets are running sums of the lengths of the pieces
    between matches and of the matches themselves, so no driver or Python step is involved.  A text without
    a match costs one regex pass.
    """
    return F.expr(spans_sql(text, java_regex))


#: code points of a block: a text is cut into blocks once, and places are looked up in their block
BLOCK = 1024


def blocks_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def _newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\n', '')))"


def line_starts_sql(blocks: str) -> str:
    """Newlines before each block."""
    return scan_sql(blocks, "0", f"s.state + {_newlines('x')}", "s.state", "int")


def line_sql(blocks: str, before: str, offset: str) -> str:
    """1-based line of a 0-based code point offset, by the names of the blocks and of :func:`line_starts_sql`."""
    at = f"cast({offset} div {BLOCK} AS int)"
    inside = _newlines(f"left(get({blocks}, {at}), cast({offset} % {BLOCK} AS int))")
    # an offset at the very end of the text may lie behind the last block
    last = f"(element_at({before}, -1) + {_newlines(f'element_at({blocks}, -1)')})"
    return f"(1 + CASE WHEN size({blocks}) = 0 THEN 0 WHEN {at} < size({blocks}) THEN get({before}, {at}) + {inside} ELSE {last} END)"


def lines_of_offsets(text: str, offsets: str) -> Column:
    """1-based lines of an array of 0-based code point offsets into ``text`` (both SQL), in one pass over the text."""
    return F.expr(f"""transform(array({blocks_sql(text)}), b -> transform(array({line_starts_sql('b')}), n ->
        transform({offsets}, o -> {line_sql('b', 'n', 'o')}))[0])[0]""")


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text, given its blocks: costs their own length, not the length of the text."""
    first, last = (F.call_function("div", p, F.lit(BLOCK)).cast("int") for p in (start, end))
    inside = F.substring(F.get(blocks, first), start % BLOCK + 1, end - start)
    across = F.concat(
        F.substring(F.get(blocks, first), start % BLOCK + 1, F.lit(BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % BLOCK), F.lit("")),
    )
    return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)
