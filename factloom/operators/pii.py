"""Detection and scrubbing of personal data, health data and secrets.

All scanning happens inside the row that holds the text: no shuffle, whatever the size of a source.
Column functions (``detect``, ``resolve``, ``apply_tokens``) compose; the DataFrame functions below
them are the table-level operators.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.arrays import explode_once, let, posexplode_once, scan
from factloom.functions.numbers import sha256_hex
from factloom.functions.paths import basename, extname
from factloom.functions.regex import BLOCK, any_word, cut, spans_sql, sql_literal, to_java, trim_ws

_HIT = "struct<start_pos:int,neg_pct:int,ord:int,end_pos:int,matched:string>"
_RAW = f"array<{_HIT}>"

DETECTIONS = (
    "array<struct<ref_id:string,pattern_id:string,category:string,pii_type:string,confidence:string,"
    "confidence_pct:int,hipaa_identifier:string,safe_harbor_item:string,start_pos:int,end_pos:int,"
    "matched:string,token:string>>"
)


def _java(p: signals.PiiPattern) -> str:
    return to_java(p.regex, p.flags, word_start=p.word_start, word_end=p.word_end)


#: the longest run of digits that a text is asked for, 0 for none
_DIGIT_RUNS = (1, 3, 5)

#: what a text must have for a pattern to match, by regex and flags: a run of so many digits, and one of the strings (in lower case with flag 'i')
_FIRST_SIGHT: dict[tuple[str, str], tuple[int, tuple[str, ...]]] = {
    regex: (digits, parts)
    for pattern_id, digits, parts in (
        ("secret-gh-token", 0, ("ghp_", "github_pat_", "ghs_")), ("phi-ssn", 3, ()), ("phi-phone", 3, ()), ("phi-date", 3, ()), ("phi-date-iso", 3, ()),
        ("phi-mrn", 5, ("mr",)), ("phi-hpbn", 1, ("hpbn", "ben")), ("phi-ipv4", 1, (".",)), ("pii-credit-card", 5, ()), ("pii-passport", 5, ()), ("phi-zip", 5, ()),
    )
    for regex in [next((p.regex, p.flags) for p in signals.PII_PATTERNS if p.pattern_id == pattern_id)]
}


def _digits_sql(text: str) -> str:
    """The longest of ``_DIGIT_RUNS`` that the text has, 0 for a text without a digit: it passes one search instead of ten."""
    missing = " ".join(f"WHEN NOT {text} RLIKE '[0-9]{{{n}}}' THEN {before}" for before, n in zip((0, *_DIGIT_RUNS), _DIGIT_RUNS))
    return f"CASE {missing} ELSE {_DIGIT_RUNS[-1]} END"


def detect_sql(text: str, patterns: Sequence[signals.PiiPattern] = signals.PII_PATTERNS) -> str:
    """SQL text of :func:`detect`, for use inside the lambda of another array."""

    def tagged(n: int, p: signals.PiiPattern) -> str:
        spans = f"""transform({spans_sql(text, _java(p))}, s -> named_struct('start_pos', s.start_pos,
            'neg_pct', {-p.confidence_pct}, 'ord', {n}, 'end_pos', s.end_pos, 'matched', s.matched))"""
        holder, folded = (f"lower({text})", str.lower) if "i" in p.flags else (text, str)
        digits, parts = _FIRST_SIGHT.get((p.regex, p.flags), (0, ()))
        tests = [f"contains({holder}, {sql_literal(folded(p.needs))})"] if p.needs else []
        if parts:
            tests.append("(" + " OR ".join(f"contains({holder}, {sql_literal(folded(part))})" for part in parts) + ")")
        if digits:
            tests.insert(0, f"_digits >= {digits}")
        if tests:
            spans = f"CASE WHEN {' AND '.join(tests)} THEN {spans} ELSE cast(array() AS {_RAW}) END"
        return spans

    per_pattern = ", ".join(tagged(n, p) for n, p in enumerate(patterns, 1))
    return f"transform(array({_digits_sql(text)}), _digits -> array_sort(flatten(array({per_pattern}))))[0]"


def detect(text: str, patterns: Sequence[signals.PiiPattern] = signals.PII_PATTERNS) -> Column:
    """Every match of every pattern in ``text`` (a column name or SQL expression), ordered by start, then
    confidence (high first), then pattern order."""
    return F.expr(detect_sql(text, patterns))


def resolve(raw: Column) -> Column:
    """Drop overlaps: in start order keep a hit that begins at or after the end of the last kept one."""

    def step(last_end: Column, d: Column) -> Column:
        keep = d["start_pos"] >= last_end
        return F.struct(F.when(keep, d["end_pos"]).otherwise(last_end).alias("state"), F.when(keep, d).alias("value"))

    return let(raw, lambda hits: F.when(F.size(hits) <= 1, hits).otherwise(scan(hits, F.lit(-1), step, _HIT)))


def _attr(patterns, field: str, ord_col: Column) -> Column:
    def sql(v) -> str:
        return "cast(null as string)" if v is None else str(v) if isinstance(v, int) else sql_literal(v)

    return F.element_at(F.expr("array(" + ", ".join(sql(getattr(p, field)) for p in patterns) + ")"), ord_col)


def ref_id(key: Column, field: Column, start: Column, pattern_id: Column) -> Column:
    """Deterministic reference id of one detection (128 bits as hex digits), unique over a corpus of any size."""
    joined = F.concat_ws("|", key.cast("string"), field, start.cast("string"), pattern_id)
    return F.left(F.sha2(joined, 256), F.lit(32))


def build_token(category: Column, pii_type: Column, ref: Column, confidence: Column) -> Column:
    """``[CATEGORY:TYPE:ref:ID:CONF:LEVEL]``, with ``:REVIEW_REQUIRED`` for uncertain levels."""
    review = F.when(confidence.isin(*signals.REVIEW_LEVELS), F.lit(":REVIEW_REQUIRED]")).otherwise(F.lit("]"))
    return F.concat(
        F.lit("["), category, F.lit(":"), pii_type, F.lit(":ref:"), ref, F.lit(":CONF:"), confidence, review
    )


def describe(kept: Column, key: Column, field: Column, patterns=signals.PII_PATTERNS) -> Column:
    """Attach the pattern attributes, the reference id and the replacement token to kept hits."""

    def one(d: Column) -> Column:
        o = d["ord"]
        ref = ref_id(key, field, d["start_pos"], _attr(patterns, "pattern_id", o))
        return F.struct(
            ref.alias("ref_id"),
            _attr(patterns, "pattern_id", o).alias("pattern_id"),
            _attr(patterns, "category", o).alias("category"),
            _attr(patterns, "pii_type", o).alias("pii_type"),
            _attr(patterns, "confidence", o).alias("confidence"),
            (-d["neg_pct"]).alias("confidence_pct"),
            _attr(patterns, "hipaa_identifier", o).alias("hipaa_identifier"),
            _attr(patterns, "safe_harbor_item", o).alias("safe_harbor_item"),
            d["start_pos"].alias("start_pos"),
            d["end_pos"].alias("end_pos"),
            d["matched"].alias("matched"),
            build_token(
                _attr(patterns, "category", o), _attr(patterns, "pii_type", o), ref, _attr(patterns, "confidence", o)
            ).alias("token"),
        )

    return F.transform(kept, one)


def apply_tokens(text: Column, detections: Column) -> Column:
    """Replace every detection by its token; detections are ordered and do not overlap.  The text is cut into blocks once and put
    together once, so time follows its length and the number of detections."""

    def put(blocks: Column, found: Column) -> Column:
        def piece(d: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end_pos"])
            return F.concat(cut(blocks, before, d["start_pos"]), d["token"])

        rest = cut(blocks, F.element_at(found, -1)["end_pos"], F.length(text))
        return F.concat(F.array_join(F.transform(found, piece), ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(detections) == 0, text).otherwise(let(blocks, lambda b: let(detections, lambda found: put(b, found))))


# ---------------------------------------------------------------- table-level operators


def detect_pii(df: DataFrame, keys: Sequence[str], text: str = "text", patterns=signals.PII_PATTERNS) -> DataFrame:
    """All raw matches, one row each, overlaps included."""
    hits = df.select(*keys, F.explode(detect(text, patterns)).alias("d"))
    o = F.col("d.ord")
    return hits.select(
        *keys,
        _attr(patterns, "pattern_id", o).alias("pattern_id"),
        _attr(patterns, "category", o).alias("category"),
        _attr(patterns, "pii_type", o).alias("pii_type"),
        _attr(patterns, "confidence", o).alias("confidence"),
        (-F.col("d.neg_pct")).alias("confidence_pct"),
        _attr(patterns, "safe_harbor_item", o).alias("safe_harbor_item"),
        F.col("d.start_pos").alias("start_pos"),
        F.col("d.end_pos").alias("end_pos"),
    )


def scrub(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    field: str | None = None,
    patterns=signals.PII_PATTERNS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``keys`` + ``text`` -> ``keys``, ``detections`` (array), ``scrubbed``, ``payload_hash``; columns named in ``carry`` stay and are
    no part of the reference ids.

    ``field`` names the column that holds the JSON field of the text (default: the column name);
    values of structural fields pass through untouched.
    """
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    field_col = F.col(field) if field else F.lit(text)
    gate = ~field_col.isin(*signals.STRUCTURAL_FIELDS)
    described = describe(resolve(detect(text, patterns)), key, field_col, patterns)
    extra = [field] if field and field not in keys else []
    gated = F.when(gate, described).otherwise(F.expr(f"cast(array() as {DETECTIONS})"))
    out = df.select(*keys, *extra, *carry, F.col(text).alias("_text"), gated.alias("detections"))
    out = out.withColumn("scrubbed", apply_tokens(F.col("_text"), F.col("detections")))
    return out.withColumn("payload_hash", payload_hash(F.col("scrubbed"), text)).drop("_text")


def payload_hash(scrubbed: Column, name: str = "text") -> Column:
    """Hash of the JSON form of the scrubbed payload."""
    return sha256_hex(F.to_json(F.struct(scrubbed.alias(name)), {"ignoreNullFields": "false"}))


def detections(scrubbed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept detections of :func:`scrub`, one row each with their position in the text order."""
    return scrubbed.select(*keys, posexplode_once("detections").alias("pos", "d")).select(
        *keys, (F.col("pos") + 1).alias("seq"), "d.*"
    )


def detection_counts(scrubbed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PHI / PII / SECRET counts of each payload, taken from its own array (no shuffle)."""

    def n(cat: str) -> Column:
        return F.size(F.filter("detections", lambda d: d["category"] == cat)).cast("long")

    return scrubbed.select(
        *keys, n("PHI").alias("phi_count"), n("PII").alias("pii_count"), n("SECRET").alias("secret_count")
    )


def counts_by_type(scrubbed: DataFrame) -> DataFrame:
    """Corpus-wide counts by category and type, combined map-side."""
    hits = scrubbed.select(explode_once("detections").alias("d"))
    return hits.groupBy(F.col("d.category").alias("category"), F.col("d.pii_type").alias("pii_type")).agg(
        F.count("*").alias("hits"), F.sum(F.length("d.matched")).alias("chars_replaced")
    )


def uncertain_detections(scrubbed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Review rows: kept detections whose level is uncertain or low."""
    rows = detections(scrubbed, keys).filter(F.col("confidence").isin(*signals.REVIEW_LEVELS))
    trigger = F.concat(
        F.lit("Pattern: "), F.col("pattern_id"), F.lit(' matched "'), F.left("matched", F.lit(40)), F.lit('"')
    )
    return rows.select(
        *keys,
        F.col("ref_id").alias("entry_id"),
        trigger.alias("trigger"),
        "confidence",
        "confidence_pct",
        F.lit(True).alias("is_approximate_range"),
        F.lit(False).alias("marked_reviewed"),
    )


def purity_check(df: DataFrame, keys: Sequence[str], text: str, patterns=signals.PII_PATTERNS) -> DataFrame:
    """First surviving HIGH/MEDIUM pattern per text, in pattern order; an empty result means pure."""
    strict = [p for p in patterns if p.confidence not in signals.REVIEW_LEVELS]
    col = F.col(text)
    hit = F.coalesce(*[F.when(col.rlike(_java(p)), F.lit(n)) for n, p in enumerate(strict, 1)])
    # a generator, not a filter: a filter would be pushed below the projection that computes ``text`` and
    # repeat that (expensive) expression once per pattern
    hits = F.filter(F.array(hit), lambda n: n.isNotNull())
    found = df.select(*keys, col.alias("_text"), F.explode(hits).alias("_n"))
    regex = F.element_at(F.array(*[F.lit(_java(p)) for p in strict]), F.col("_n"))
    found = found.withColumn("_m", F.regexp_substr("_text", regex))
    return found.select(
        *keys,
        _attr(strict, "description", F.col("_n")).alias("first_pattern"),
        F.length(F.element_at(F.split("_text", regex, 2), 1)).alias("first_position"),
        F.concat(F.left("_m", F.lit(60)), F.when(F.length("_m") > 60, F.lit("…")).otherwise(F.lit(""))).alias(
            "first_value"
        ),
    )


def assert_pure(df: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[signals.PiiPattern] = signals.PII_PATTERNS, field: str | None = None) -> DataFrame:
    """Pass rows through, failing the job on the first text that a HIGH or MEDIUM one of ``patterns`` hits.  ``field`` names the column
    with the JSON field of the text; structural fields are left alone, as by :func:`scrub`."""
    strict = [p for p in patterns if p.confidence not in signals.REVIEW_LEVELS]
    col = F.col(text)
    label = F.coalesce(F.lit(None).cast("string"), *[F.when(col.rlike(_java(p)), F.lit(p.description)) for p in strict])
    if field:
        label = F.when(~F.col(field).isin(*signals.STRUCTURAL_FIELDS), label)
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    message = F.concat(F.lit("purity check failed: "), label, F.lit(" in "), key)
    guarded = F.when(label.isNotNull(), F.raise_error(message).cast("string")).otherwise(col)
    return df.withColumn(text, guarded)


# ---------------------------------------------------------------- line signals


def in_pii_scope(path: Column) -> Column:
    """Files worth a line scan: not binary, minified, vendored or a fixture."""
    name = basename(path)
    skip = F.lower(extname(name)).isin(*signals.PII_SKIP_EXTENSIONS)
    skip = skip | name.endswith(".min.js") | name.endswith(".min.css")
    for fragment in signals.PII_SKIP_FRAGMENTS:
        skip = skip | path.contains(fragment)
    return ~skip


def any_signal(line_signals=signals.LINE_SIGNALS) -> str:
    """One regex that matches texts with a signal.  Signals of the form ``\\b(?:words)\\b`` share one boundary check, so a scan tests words
    only where a word begins; the others are tried where one of their first characters stands."""
    words, others = [], []
    for rx, _ in line_signals:
        if re.fullmatch(r"\\b\(\?:[\w|]+\)\\b", rx):
            words += rx[5:-3].split("|")
        else:
            others.append(f"(?:{to_java(rx)})")
    # the character before a word is read along, which costs less at every place than to look behind
    merged = [r"(?:^|\W)(?:" + any_word(words) + r")(?!\w)"] if words else []
    firsts = [first_characters(rx) for rx, _ in line_signals if f"(?:{to_java(rx)})" in others]
    if others and all(firsts):
        others = [f"(?=[{''.join(dict.fromkeys(firsts))}])(?:{'|'.join(others)})"]
    return "(?i)" + "|".join(merged + others)


def first_characters(rx: str) -> str | None:
    """What every match of ``rx`` begins with, as the inside of a character class; None if its text does not tell."""
    depth = 0
    for ch in re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", rx):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            return None
    found = re.match(r"([A-Za-z])(?![?*{])|\[((?:\\.|[^\]\\^])(?:\\.|[^\]\\])*)\](?![?*{])", rx)
    return found and (found[1] or found[2])


def line_hint(line: Column, line_signals=signals.LINE_SIGNALS) -> Column:
    """Hint of the first signal on a line; NULL for comment lines and lines without one."""
    stripped = trim_ws(line)
    comment = F.lit(False)
    for prefix in signals.COMMENT_PREFIXES:
        comment = comment | stripped.startswith(prefix)
    hint = F.coalesce(*[F.when(line.rlike(to_java(rx, "i")), F.lit(text)) for rx, text in line_signals])
    return F.when(line.rlike(any_signal(line_signals)) & ~comment, hint)


def any_line_signal(content: Column, line_signals=signals.LINE_SIGNALS) -> Column:
    """Cheap file-level test: can any line of the file carry a signal?"""
    return content.rlike(any_signal(line_signals))


def _signalling(files: DataFrame, line_signals) -> DataFrame:
    """Files in scope with a signal.  The test comes out of a generator: a filter would be pushed below the projection that computes path and
    content, and repeat it for every use."""
    wanted = in_pii_scope(F.col("path")) & any_line_signal(F.col("content"), line_signals)
    return files.select("repo_id", "path", "content", F.explode(F.array(wanted)).alias("_wanted")).filter("_wanted").drop("_wanted")


def pii_candidate_lines(files: DataFrame, line_signals=signals.LINE_SIGNALS) -> DataFrame:
    """(repo_id, path, line_no, hint): the first signal of every signalling line."""
    scoped = _signalling(files, line_signals)
    lines = scoped.select("repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    hinted = lines.select("repo_id", "path", (F.col("i") + 1).alias("line_no"), line_hint(F.col("line"), line_signals).alias("hint"))
    return hinted.filter("hint is not null")


def pii_candidates(files: DataFrame, line_signals=signals.LINE_SIGNALS) -> DataFrame:
    """Islands of neighbouring lines with one hint: (repo_id, path, line_start, line_end, hint, island).

    An island grows while the *previous* candidate has the same hint and ends at most three lines above.
    It is found from the lines of one file inside its row, without a window or a shuffle.
    """
    scoped = _signalling(files, line_signals)
    lines = F.transform(
        F.split("content", "\n", -1), lambda l, i: F.struct((i + 1).alias("n"), line_hint(l, line_signals).alias("hint"))
    )
    marked = F.filter(lines, lambda l: l["hint"].isNotNull())

    def starts(found: Column) -> Column:
        """Places of the candidates that begin an island; each looks at its predecessor only, so nothing is carried along."""
        places = F.transform(found, lambda l, i: let(F.get(found, i - 1), lambda before: F.when(
            F.coalesce((before["hint"] == l["hint"]) & (l["n"] - 1 - before["n"] <= 2), F.lit(False)), F.lit(None)).otherwise(i)))
        return F.filter(places, lambda i: i.isNotNull())

    def bounds(found: Column, begin: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            last = F.coalesce(F.get(begin, k + 1), F.size(found)) - 1
            first = F.get(found, i)
            return F.struct(first["n"].alias("line_start"), F.get(found, last)["n"].alias("line_end"), first["hint"].alias("hint"))

        return F.transform(begin, one)

    islands = let(marked, lambda found: let(starts(found), lambda begin: bounds(found, begin)))
    out = scoped.select("repo_id", "path", F.posexplode(islands).alias("island", "c"))
    return out.select("repo_id", "path", (F.col("island") + 1).alias("island"), "c.*")


def phi_zones(candidates: DataFrame, top: int | None = 50) -> DataFrame:
    """Per file: span, number of candidates, first three hints; the busiest ``top`` files of a repository (None: all)."""
    from factloom.functions.ranking import top_k_per_group

    # hints are a small dictionary, so one first-position per hint bounds what meets per file
    per_hint = candidates.groupBy("repo_id", "path", "hint").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.count("*").alias("n"), F.min("island").alias("first_island"),
    )
    zones = per_hint.groupBy("repo_id", "path").agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
        F.sum("n").alias("phi_field_count"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("first_island", "hint"))), lambda h: h["hint"]), 1, 3).alias("hints"),
    )
    zones = zones.withColumn("dev_note", F.array_join("hints", "; ")).drop("hints")
    return top_k_per_group(zones, ["repo_id"], [F.desc("phi_field_count"), F.asc("path")], top, "zone_rank")
