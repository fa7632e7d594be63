"""String leaves of JSON payloads: walking them, and scrubbing them in place.

A payload stays text.  One regular expression cuts it into tokens; one scan over the tokens follows objects and arrays and names each
string by its path; replaced strings are put back between the untouched tokens.  So the order of members, repeated keys, numbers, nulls,
white space and escapes of everything that is not replaced stay as they were written, nothing is shuffled, and no payload is parsed
outside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.arrays import let, posexplode_once, scan
from factloom.functions.numbers import sha256_hex
from factloom.operators import pii

WS = " \t\n\r"
# possessive loops: no backtracking, no recursion on long strings
TOKEN = r'[ \t\n\r]*+(?:"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|[{}\[\]:,]|[^ \t\n\r{}\[\]:,"]++)[ \t\n\r]*+'
LEAF = "struct<token_no:int,json_path:string,field:string,value:string>"
FRAME = "struct<path:string,field:string,is_array:boolean,next:int>"
PLACED = pii.DETECTIONS.replace("array<struct<", "array<struct<json_path:string,field:string,", 1)


SCALAR = r"\A(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\z"


def is_json(payload: Column) -> Column:
    """Whether a text is exactly one JSON value (repeated keys are allowed).  The parser stops after a value, so the text is tried as an
    item of an array and as a member of an object: what breaks out of one does not break out of the other."""
    wrapped = [F.get_json_object(F.concat(F.lit(a), payload, F.lit(b)), "$").isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.coalesce(wrapped[0] & wrapped[1], F.lit(False))


def is_strict(tokens: Column) -> Column:
    """No token is a lenient form (such as a single-quoted string) that the walk would not see as a string."""
    return F.forall(tokens, lambda t: F.left(F.btrim(t, F.lit(WS)), F.lit(1)).isin(*'"{}[]:,') | F.btrim(t, F.lit(WS)).rlike(SCALAR))


def _decoded(literal: Column) -> Column:
    """The string that a literal with its quotes stands for."""
    return F.when(literal.contains("\\"), F.get_json_object(literal, "$")).otherwise(F.substring(literal, F.lit(2), F.length(literal) - 2))


def _encoded(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def string_leaves(tokens: Column, root: str, max_depth: int | None = None) -> Column:
    """array<LEAF>: every string value among the tokens of a payload, in text order.  Items of an array inherit the field of the
    array; the path of an item ends in [n], that of a member in .key."""

    def step(state: Column, token: Column) -> Column:
        return let(token["s"], lambda s: let(F.get(state["stack"], F.size(state["stack"]) - 1), lambda top: move(state, token, s, top)))

    def move(state: Column, token: Column, s: Column, top: Column) -> Column:
        kind, stack, key = F.left(s, F.lit(1)), state["stack"], state["key"]
        is_key = (kind == '"') & top.isNotNull() & ~top["is_array"] & key.isNull()
        field = F.when(top.isNull(), F.lit(root)).when(top["is_array"], top["field"]).otherwise(key)
        number = F.concat(F.lit("["), top["next"].cast("string"), F.lit("]"))
        path = F.when(top.isNull(), F.lit(root)).otherwise(F.concat(top["path"], F.when(top["is_array"], number).otherwise(F.concat(F.lit("."), key))))
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        opened = F.struct(path.alias("path"), field.alias("field"), (kind == "[").alias("is_array"), F.lit(0).alias("next"))
        counted = F.struct(top["path"].alias("path"), top["field"].alias("field"), F.lit(True).alias("is_array"), (top["next"] + 1).alias("next"))
        new_stack = (
            F.when(kind.isin("{", "["), F.array_append(stack, opened))
            .when(kind.isin("}", "]"), below)
            .when((kind == ",") & F.coalesce(top["is_array"], F.lit(False)), F.array_append(below, counted))
            .otherwise(stack)
        )
        near = F.lit(True) if max_depth is None else F.size(stack) <= max_depth
        leaf = F.struct(token["i"].alias("token_no"), path.alias("json_path"), field.alias("field"), _decoded(s).alias("value"))
        return F.struct(
            F.struct(new_stack.alias("stack"), F.when(is_key, _decoded(s)).when(kind == ":", key).alias("key")).alias("state"),
            F.when((kind == '"') & ~F.coalesce(is_key, F.lit(False)) & near, leaf).alias("value"),
        )

    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.btrim(t, F.lit(WS)).alias("s")))
    start = F.struct(F.expr(f"cast(array() as array<{FRAME}>)").alias("stack"), F.lit(None).cast("string").alias("key"))
    return scan(numbered, start, step, LEAF)


def _tokens(payload: str) -> Column:
    """Tokens of a JSON text, null for any other."""
    cut = F.regexp_extract_all(payload, F.lit(TOKEN), F.lit(0))
    return F.when(is_json(F.col(payload)), let(cut, lambda t: F.when(is_strict(t), t)))


def walk_string_leaves(df: DataFrame, key: str, payload: str, root: str = "root", max_depth: int | None = None) -> DataFrame:
    """(key, leaf_no, json_path, field, value, scrubbable) for every string below a JSON payload; none for other texts."""
    walked = df.select(key, _tokens(payload).alias("_tokens")).where("_tokens is not null")
    leaves = walked.select(key, string_leaves(F.col("_tokens"), root, max_depth).alias("_leaves"))
    rows = leaves.select(key, posexplode_once("_leaves").alias("n", "l"))
    return rows.select(
        key, (F.col("n") + 1).alias("leaf_no"), "l.json_path", "l.field", "l.value",
        (~F.col("l.field").isin(*signals.STRUCTURAL_FIELDS)).alias("scrubbable"),
    )


def scrub_json(
    df: DataFrame, keys: Sequence[str], payload: str = "payload", root: str = "root",
    patterns: Sequence[signals.PiiPattern] = signals.PII_PATTERNS, max_depth: int | None = None,
) -> DataFrame:
    """``keys`` + JSON text -> ``keys``, ``detections``, ``scrubbed``, ``payload_hash``: the same document with tokens in its strings.

    Strings of structural fields pass.  A detection carries the ``json_path`` and ``field`` of its string, places count in the string
    as decoded, and its reference id depends on key, path, number of the token and place.  A replaced string is written with JSON escapes; every other
    character of the payload stays.  A text that is not JSON is scrubbed as one string under ``root``, so that nothing leaks by being
    malformed; null stays null, without detections.  Strings deeper than ``max_depth`` containers pass (None: none is too deep).
    """
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    cols = [F.col(f"`{k}`") for k in keys]
    work = df.select(*cols, F.col(payload).alias("_payload"), key.alias("_key"), _tokens(payload).alias("_tokens"))
    plain = F.struct(F.lit(-1).alias("token_no"), F.lit(root).alias("json_path"), F.lit(root).alias("field"), F.col("_payload").alias("value"))
    leaves = (
        F.when(F.col("_payload").isNull(), F.expr(f"cast(array() as array<{LEAF}>)"))
        .when(F.col("_tokens").isNull(), F.array(plain))
        .otherwise(string_leaves(F.col("_tokens"), root, max_depth))
    )
    work = work.withColumn("_leaves", F.filter(leaves, lambda l: ~l["field"].isin(*signals.STRUCTURAL_FIELDS)))
    found = F.expr(f"transform(_leaves, leaf -> named_struct('leaf', leaf, 'raw', {pii.detect_sql('leaf.value', patterns)}))")
    work = work.withColumn("_found", F.filter(found, lambda h: F.size(h["raw"]) > 0))

    def replaced(hit: Column) -> Column:
        leaf = hit["leaf"]
        # the number of the token tells members of one name apart
        place = F.concat(leaf["json_path"], F.lit("#"), leaf["token_no"].cast("string"))
        return let(pii.describe(pii.resolve(hit["raw"]), F.col("_key"), place, patterns), lambda kept: F.struct(
            leaf["token_no"].alias("token_no"), leaf["json_path"].alias("json_path"), leaf["field"].alias("field"),
            kept.alias("kept"), pii.apply_tokens(leaf["value"], kept).alias("text")))

    work = work.withColumn("_hits", F.transform("_found", replaced)).drop("_leaves", "_found")
    names = [c.split(":")[0] for c in PLACED.removeprefix("array<struct<").removesuffix(">>").split(",")]
    placed = F.flatten(F.transform("_hits", lambda h: F.transform(h["kept"], lambda d: F.struct(
        h["json_path"].alias("json_path"), h["field"].alias("field"), *[d[n].alias(n) for n in names[2:]]))))

    def put_back(tokens: Column, hits: Column) -> Column:
        def piece(hit: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(-1)).otherwise(F.get(hits, k - 1)["token_no"])
            old = F.get(tokens, hit["token_no"])
            space = [F.regexp_extract(old, rx, 0) for rx in (r"\A[ \t\n\r]*+", r"[ \t\n\r]*+\z")]
            new = F.concat(space[0], _encoded(hit["text"]), space[1])
            return F.concat(F.slice(tokens, before + 2, hit["token_no"] - before - 1), F.array(new))

        rest = F.slice(tokens, F.element_at(hits, -1)["token_no"] + 2, F.size(tokens))
        return F.array_join(F.concat(F.flatten(F.transform(hits, piece)), rest), "")

    text = (
        F.when(F.size("_hits") == 0, F.col("_payload"))
        .when(F.col("_tokens").isNull(), F.get("_hits", F.lit(0))["text"])
        .otherwise(put_back(F.col("_tokens"), F.col("_hits")))
    )
    out = work.select(*cols, placed.alias("detections"), text.alias("scrubbed"))
    return out.withColumn("payload_hash", sha256_hex(F.col("scrubbed")))


def impure_leaves(df: DataFrame, keys: Sequence[str], payload: str, patterns: Sequence[signals.PiiPattern] = signals.PII_PATTERNS, root: str = "root") -> DataFrame:
    """(keys, json_path, first_pattern, first_position, first_value) of scrubbable strings that a HIGH or MEDIUM pattern still hits; an
    empty result means that the payloads are pure.  Structural fields are left alone, as by the scrubber."""
    cols = [F.col(f"`{k}`") for k in keys]
    tokens = _tokens(payload)
    plain = F.struct(F.lit(-1).alias("token_no"), F.lit(root).alias("json_path"), F.lit(root).alias("field"), F.col(payload).alias("value"))
    walked = df.where(F.col(payload).isNotNull()).select(*cols, F.col(payload), tokens.alias("_tokens"))
    leaves = walked.select(*cols, F.when(F.col("_tokens").isNull(), F.array(plain)).otherwise(string_leaves(F.col("_tokens"), root)).alias("_leaves"))
    rows = leaves.select(*cols, posexplode_once("_leaves").alias("_n", "_l")).select(*cols, "_l.json_path", "_l.field", "_l.value")
    scrubbable = rows.where(~F.col("field").isin(*signals.STRUCTURAL_FIELDS))
    return pii.purity_check(scrubbable, [*keys, "json_path"], "value", patterns)
