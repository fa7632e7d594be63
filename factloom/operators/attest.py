"""Hash-linked audit chains.

A chain of one scrubbed payload is built inside the row that holds the payload (``attestation_chain``).  A chain over all payloads of a
repository (``linked_chain``) is numbered by bucket totals and linked block by block: a hash chain is serial by nature, but all
chains advance at once, a task holds one block of one chain, and the head of a block is handed on to the next.  Verification links each
entry to its predecessor with an equi-join on (chain, sequence number), which spreads evenly however long a chain is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.arrays import let, posexplode_once, scan
from factloom.functions.checkpoints import scratch, stored
from factloom.functions.numbers import sha256_hex
from factloom.functions.ranking import ordinal

GENESIS = "0" * 64
ACTION = "REPLACED_WITH_TOKEN"

# Members of an audit entry in serialization order, (JSON name, column, SQL type).
ENTRY_FIELDS = (
    ("entryId", "entry_id", "string"), ("chainSeq", "chain_seq", "long"), ("prevHash", "prev_hash", "string"),
    ("detectedAt", "detected_at", "string"), ("analystId", "analyst_id", "string"), ("repo", "repo", "string"),
    ("repoCommit", "repo_commit", "string"), ("file", "file", "string"), ("lineStart", "line_start", "int"),
    ("lineEnd", "line_end", "int"), ("colStart", "col_start", "int"), ("colEnd", "col_end", "int"),
    ("piiCategory", "pii_category", "string"), ("piiType", "pii_type", "string"),
    ("hipaaIdentifier", "hipaa_identifier", "string"), ("hipaaSafeHarborItem", "hipaa_safe_harbor_item", "string"),
    ("scrubConfidence", "scrub_confidence", "string"), ("scrubAction", "scrub_action", "string"),
    ("tokenPlaced", "token_placed", "string"), ("payloadHash", "payload_hash", "string"),
)
JSON_OPTIONS = {"ignoreNullFields": "false"}
ENTRY_SCHEMA = ", ".join(f"{js} {t}" for js, _, t in ENTRY_FIELDS) + ", thisHash string"


def _json(members: dict[str, Column], this_hash: Column | None = None) -> Column:
    cols = [members[name].alias(js) for js, name, _ in ENTRY_FIELDS]
    if this_hash is not None:
        cols.append(this_hash.alias("thisHash"))
    return F.to_json(F.struct(*cols), JSON_OPTIONS)


def attestation_chain(
    scrubbed: DataFrame, chain: str, analyst_id: str, repo: Column, commit: Column, detected_at: Column
) -> DataFrame:
    """Entries of every chain.  ``scrubbed`` is the result of ``pii.scrub``; ``chain`` names its key column.

    ``this_hash`` covers the entry without it; ``prev_hash`` of the next entry covers the whole entry.
    """
    link_type = "struct<chain_seq:int,prev_hash:string,this_hash:string,ref_id:string>"

    def members(d: Column, seq: Column, prev: Column) -> dict[str, Column]:
        return {
            "entry_id": d["ref_id"], "chain_seq": seq, "prev_hash": prev, "detected_at": F.col("_at"),
            "analyst_id": F.lit(analyst_id), "repo": F.col("_repo"), "repo_commit": F.col("_commit"),
            "file": F.col("_file"), "line_start": F.lit(1), "line_end": F.lit(1),
            "col_start": d["start_pos"], "col_end": d["end_pos"], "pii_category": d["category"],
            "pii_type": d["pii_type"], "hipaa_identifier": d["hipaa_identifier"],
            "hipaa_safe_harbor_item": d["safe_harbor_item"], "scrub_confidence": d["confidence"],
            "scrub_action": F.lit(ACTION), "token_placed": d["token"], "payload_hash": F.col("payload_hash"),
        }

    base = scrubbed.select(
        chain, "detections", "payload_hash", repo.alias("_repo"), commit.alias("_commit"),
        detected_at.cast("string").alias("_at"),
        F.concat(F.lit("[payload:"), F.col(chain).cast("string"), F.lit("]")).alias("_file"),
    )

    def step(state: Column, d: Column) -> Column:
        m = members(d, state["seq"] + 1, state["prev"])
        return let(sha256_hex(_json(m)), lambda this: F.struct(
            F.struct((state["seq"] + 1).alias("seq"), sha256_hex(_json(m, this)).alias("prev")).alias("state"),
            F.struct((state["seq"] + 1).alias("chain_seq"), state["prev"].alias("prev_hash"), this.alias("this_hash"), d["ref_id"].alias("ref_id")).alias("value"),
        ))

    links = scan(F.col("detections"), F.struct(F.lit(0).alias("seq"), F.lit(GENESIS).alias("prev")), step, link_type)
    rows = base.withColumn("_links", links).select("*", F.explode(F.arrays_zip("_links", "detections")).alias("z"))
    m = members(F.col("z.detections"), F.col("z._links.chain_seq"), F.col("z._links.prev_hash"))
    return rows.select(
        F.col(chain).alias("chain_id"), *[m[name].alias(name) for _, name, _ in ENTRY_FIELDS],
        F.col("z._links.this_hash").alias("this_hash"),
    )


#: entries of one chain that one task links in a row
BLOCK = 1_000_000
LINKED = ("chain_seq", "prev_hash")


def unlinked_entries(
    scrubbed: DataFrame, chain: str, payload: str, analyst_id: str, repo: Column, commit: Column, detected_at: Column
) -> DataFrame:
    """One row per replacement: chain_id, payload, place (its number in the payload) and the members of an audit entry but its number
    and hashes.  ``scrubbed`` is the result of ``pii.scrub`` or ``json_leaves.scrub_json`` with the columns ``chain`` and ``payload``;
    entries of a JSON payload name the path of their string."""
    nested = "json_path" in scrubbed.schema["detections"].dataType.elementType.names
    rows = scrubbed.select(
        F.col(chain).alias("chain_id"), F.col(payload).alias("payload"), posexplode_once("detections").alias("place", "d"), "payload_hash",
        repo.alias("_repo"), commit.alias("_commit"), detected_at.cast("string").alias("_at"),
    )
    where = F.concat(F.col("payload").cast("string"), F.lit("/"), F.col("d.json_path")) if nested else F.col("payload").cast("string")
    members = {
        "entry_id": F.col("d.ref_id"), "detected_at": F.col("_at"), "analyst_id": F.lit(analyst_id), "repo": F.col("_repo"),
        "repo_commit": F.col("_commit"), "file": F.concat(F.lit("[payload:"), where, F.lit("]")), "line_start": F.lit(1), "line_end": F.lit(1),
        "col_start": F.col("d.start_pos"), "col_end": F.col("d.end_pos"), "pii_category": F.col("d.category"), "pii_type": F.col("d.pii_type"),
        "hipaa_identifier": F.col("d.hipaa_identifier"), "hipaa_safe_harbor_item": F.col("d.safe_harbor_item"),
        "scrub_confidence": F.col("d.confidence"), "scrub_action": F.lit(ACTION), "token_placed": F.col("d.token"), "payload_hash": F.col("payload_hash"),
    }
    return rows.select("chain_id", "payload", "place", *[c.alias(n) for n, c in members.items()])


def json_sides(entries: DataFrame) -> DataFrame:
    """Adds ``_left`` and ``_right``: the serialized entry up to its number, and from behind its ``prevHash`` on."""
    first, rest = ENTRY_FIELDS[0], [f for f in ENTRY_FIELDS[1:] if f[1] not in LINKED]
    left = F.to_json(F.struct(F.col(first[1]).alias(first[0])), JSON_OPTIONS)
    right = F.to_json(F.struct(*[F.col(name).alias(js) for js, name, _ in rest]), JSON_OPTIONS)
    return entries.withColumns({
        "_left": F.substring(left, F.lit(1), F.length(left) - 1), "_right": F.concat(F.lit('",'), F.substring(right, F.lit(2), F.length(right)))})


def _linker():
    """(left, right, number, prev) -> (this hash, hash of the whole entry).  Made by a function, so that it travels by value."""

    def sha(text: str) -> str:
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    def link(left: str, right: str, number: int, prev: str) -> tuple[str, str]:
        body = f'{left},"chainSeq":{number},"prevHash":"{prev}{right}'
        this = sha(body)
        return this, sha(f'{body[:-1]},"thisHash":"{this}"}}')

    return link


def _link_block(rows: DataFrame) -> DataFrame:
    """Links rows that lie sorted by (chain_id, chain_seq) in their partition, each chain from its ``_head`` on."""
    names, link = rows.columns, _linker()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, prev = object(), ""
        for batch in batches:
            added = []
            columns = [batch.column(names.index(n)).to_pylist() for n in ("chain_id", "chain_seq", "_head", "_left", "_right")]
            for c, number, head, left, right in zip(*columns):
                if c != chain:
                    chain, prev = c, head
                this, after = link(left, right, number, prev)
                added.append((prev, this, after))
                prev = after
            new = [pa.array(x, pa.string()) for x in zip(*added)] if added else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "prev_hash", "this_hash", "_after"])

    added_fields = "prev_hash string, this_hash string, _after string"
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + added_fields)


def linked_chain(entries: DataFrame, heads: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One chain per chain_id over all ``unlinked_entries``, in the order of (payload, place).

    ``heads`` (chain_id, chain_seq, head) lets chains go on from what :func:`chain_heads` says of entries written before.  Equal
    (payload, place) have no defined order among each other; the chain holds in any case.  A null chain_id is a chain like others.
    """
    spark = entries.sparkSession
    # dealing by range samples its input first; stored, so that texts are scrubbed once
    entries = stored(entries, "unlinked")
    order = [F.asc_nulls_first("payload"), F.asc("place"), F.asc("entry_id")]
    ranged = entries.repartitionByRange("chain_id", "payload", "place", "entry_id")
    # the number of a range grows along the order; stored, so that it stays what it was
    placed = stored(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_chain", F.coalesce(F.col("chain_id").cast("string"), F.lit("\0null"))), "entries")
    numbered = ordinal(placed, ["_chain"], F.col("_range"), order, "chain_seq").drop("_range")
    start = F.lit(GENESIS)
    if heads is not None:
        known = heads.select(F.coalesce(F.col("chain_id").cast("string"), F.lit("\0null")).alias("_chain"), F.col("chain_seq").alias("_before"), F.col("head").alias("_known"))
        numbered = numbered.join(known, "_chain", "left").withColumn("chain_seq", F.col("chain_seq") + F.coalesce("_before", F.lit(0).cast("long")))
        first = F.coalesce("_before", F.lit(0).cast("long"))
        numbered = numbered.withColumn("_block", F.call_function("div", F.col("chain_seq") - first - 1, F.lit(block)))
        start = F.coalesce("_known", F.lit(GENESIS))
    else:
        numbered = numbered.withColumn("_block", F.call_function("div", F.col("chain_seq") - 1, F.lit(block)))
    sided = json_sides(numbered.withColumn("_start", start).drop("_before", "_known"))
    path = scratch(spark, "numbered")
    sided.write.partitionBy("_block").parquet(path)
    table = spark.read.schema(sided.schema).parquet(path)
    last = table.agg(F.max("_block")).first()[0]
    done: list[DataFrame] = []
    for number in range((-1 if last is None else last) + 1):
        rows = table.where(F.col("_block") == number).drop("_block")
        if number:
            # one row per chain that goes on
            ends = done[-1].groupBy("_chain").agg(F.max_by("_after", "chain_seq").alias("_head"))
            rows = rows.drop("_start").join(ends, "_chain")
        else:
            rows = rows.withColumnRenamed("_start", "_head")
        ordered = rows.repartition("_chain").sortWithinPartitions("_chain", "chain_seq")
        done.append(stored(_link_block(ordered), "linked"))
    names = ["chain_id", "payload", "place", *[name for _, name, _ in ENTRY_FIELDS], "this_hash"]
    if not done:
        return entries.withColumns({"chain_seq": F.lit(1).cast("long"), "prev_hash": F.lit(GENESIS), "this_hash": F.lit("")}).select(*names).limit(0)
    return reduce(DataFrame.unionByName, [d.select(*names) for d in done])


def chain_heads(entries: DataFrame) -> DataFrame:
    """(chain_id, chain_seq, head): number of the last entry of each chain and the hash that its next entry refers to."""
    members = {name: F.col(name) for _, name, _ in ENTRY_FIELDS}
    newest = entries.select("chain_id", "chain_seq", F.struct(*members, "this_hash").alias("e")).groupBy("chain_id").agg(
        F.max("chain_seq").alias("chain_seq"), F.max_by("e", "chain_seq").alias("e"))
    flat = newest.select("chain_id", "chain_seq", *[F.col(f"e.{n}").alias(f"_{n}") for n in [*members, "this_hash"]])
    return flat.select("chain_id", "chain_seq", sha256_hex(_json({n: F.col(f"_{n}") for n in members}, F.col("_this_hash"))).alias("head"))


def verify_chain(entries: DataFrame, by: Sequence[str] = ("chain_id",)) -> DataFrame:
    """Per chain: number of entries, whether it holds, and the first error in sequence order.

    ``by`` names the columns that tell chains apart: ("chain_id", "batch") for what ``streaming.jobs.attest_batch`` writes,
    where a payload that arrives in two batches has a chain in each.

    An entry is wrong when its number is repeated or has no direct predecessor, when ``prev_hash`` is not the hash of the
    predecessor, or when ``this_hash`` does not cover its members.
    """
    members = {name: F.col(name) for _, name, _ in ENTRY_FIELDS}
    checked = entries.select(
        *by, "chain_seq", "prev_hash",
        (F.col("this_hash") == sha256_hex(_json(members))).alias("hash_ok"),
        sha256_hex(_json(members, F.col("this_hash"))).alias("full_hash"),
    )
    # each entry meets its successor on (chain, number): one scan, one evenly spread shuffle
    none = F.lit(None).cast("string")
    roles = F.array(
        F.struct("chain_seq", "prev_hash", "hash_ok", F.lit(1).alias("copies"), none.alias("expected")),
        F.struct(
            (F.col("chain_seq") + 1).alias("chain_seq"), none.alias("prev_hash"),
            F.lit(None).cast("boolean").alias("hash_ok"), F.lit(0).alias("copies"), F.col("full_hash").alias("expected"),
        ),
    )
    linked = (
        checked.select(*by, F.explode(roles).alias("r"))
        .select(*by, "r.*")
        .groupBy(*by, "chain_seq")
        .agg(
            F.min("prev_hash").alias("prev_hash"), F.min("hash_ok").alias("hash_ok"),
            F.sum("copies").alias("copies"), F.min("expected").alias("expected"),
        )
        .filter("copies > 0")
    )
    expected = F.when(F.col("chain_seq") == 1, F.lit(GENESIS)).otherwise(F.col("expected"))
    label = F.concat(F.lit("Entry "), F.col("chain_seq").cast("string"), F.lit(": "))
    error = (
        F.when(expected.isNull() | (F.col("copies") > 1), F.concat(label, F.lit("chainSeq out of order")))
        .when(F.col("prev_hash") != expected, F.concat(label, F.lit("prevHash mismatch")))
        .when(~F.col("hash_ok"), F.concat(label, F.lit("thisHash tampered")))
    )
    return (
        linked.select(*by, "chain_seq", "copies", error.alias("error"))
        .groupBy(*by)
        .agg(
            F.sum("copies").alias("entries"),
            F.expr("min_by(error, chain_seq) filter (where error is not null)").alias("first_error"),
        )
        .select(*by, "entries", F.col("first_error").isNull().alias("valid"), "first_error")
    )
