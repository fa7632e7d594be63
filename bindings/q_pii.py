"""Queries of the detection, scrubbing and audit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import relations as rel
from factloom.functions.arrays import explode_once
from factloom.functions.checkpoints import stored
from factloom.functions.regex import lines_of_offsets
from factloom.operators import attest, json_leaves, pii

DETECTED_AT = "2024-01-01T00:00:00.000Z"


def _scrubbed(spark, sf):
    return pii.scrub(rel.pii_texts(spark, sf), ["doc_id"])


def detect_pii(spark, sf) -> DataFrame:
    return pii.detect_pii(rel.pii_texts(spark, sf), ["doc_id"])


def resolve_overlaps(spark, sf) -> DataFrame:
    return pii.detections(_scrubbed(spark, sf), ["doc_id"]).select(
        "doc_id", "seq", "pattern_id", "start_pos", "end_pos", "confidence", "confidence_pct"
    )


def build_token(spark, sf) -> DataFrame:
    return pii.detections(_scrubbed(spark, sf), ["doc_id"]).select("doc_id", "seq", "ref_id", "token")


def scrub_value(spark, sf) -> DataFrame:
    return _scrubbed(spark, sf).select(
        "doc_id", "scrubbed", "payload_hash", F.size("detections").cast("long").alias("hits")
    )


def structural_gate(spark, sf) -> DataFrame:
    """The same texts under a structural field name pass untouched."""
    texts = rel.pii_texts(spark, sf).withColumn("field", F.when(F.col("doc_id") % 2 == 0, "name").otherwise("note"))
    return pii.scrub(texts, ["doc_id"], field="field").select(
        "doc_id", "field", "scrubbed", F.size("detections").cast("long").alias("hits")
    )


def detection_counts(spark, sf) -> DataFrame:
    return pii.detection_counts(_scrubbed(spark, sf), ["doc_id"])


def counts_by_type(spark, sf) -> DataFrame:
    return pii.counts_by_type(_scrubbed(spark, sf))


def uncertain_detections(spark, sf) -> DataFrame:
    return pii.uncertain_detections(_scrubbed(spark, sf), ["doc_id"])


def purity_check(spark, sf) -> DataFrame:
    """On the raw texts: which pattern would stop the run."""
    return pii.purity_check(rel.pii_texts(spark, sf), ["doc_id"], "text")


def purity_after_scrub(spark, sf) -> DataFrame:
    """On the scrubbed texts: impure and total."""
    scrubbed = _scrubbed(spark, sf).select("doc_id", "scrubbed")
    flagged = pii.purity_check(scrubbed, ["doc_id"], "scrubbed").select(F.lit(1).alias("impure"), F.lit(0).alias("n"))
    total = scrubbed.select(F.lit(0).alias("impure"), F.lit(1).alias("n"))
    return flagged.union(total).agg(F.sum("impure").alias("impure_texts"), F.sum("n").alias("texts"))


def line_of_match(spark, sf) -> DataFrame:
    kept = pii.scrub(rel.pii_texts(spark, sf), ["doc_id", "text"]).select("doc_id", "text", F.transform("detections", lambda d: d["start_pos"]).alias("starts"))
    found = kept.select("doc_id", F.arrays_zip(F.col("starts").alias("start_pos"), lines_of_offsets("text", "starts").alias("line_no")).alias("places"))
    return found.select("doc_id", explode_once("places").alias("p")).select("doc_id", "p.start_pos", "p.line_no")


def _chain(spark, sf):
    return attest.attestation_chain(
        _scrubbed(spark, sf), "doc_id", "analyst", F.lit("documents"), F.lit("HEAD"), F.lit(DETECTED_AT)
    )


def attestation_chain(spark, sf) -> DataFrame:
    return _chain(spark, sf)


def verify_chain(spark, sf) -> DataFrame:
    """Every chain as written, and a copy (negative id) whose second entry was edited afterwards."""
    good = _chain(spark, sf)
    edited = good.withColumn("chain_id", -F.col("chain_id") - 1).withColumn(
        "token_placed", F.when(F.col("chain_seq") == 2, F.lit("[edited]")).otherwise(F.col("token_placed"))
    )
    return attest.verify_chain(good.unionByName(edited))


def _source_entries(spark, sf) -> DataFrame:
    """Replacements of every document under its source, and of the notes under 'notes'."""
    sources = rel.table(spark, sf, "documents").select(F.col("doc_id").alias("payload"), F.coalesce("source", F.lit("")).alias("chain_id"))
    scrubbed = pii.scrub(rel.pii_texts(spark, sf), ["doc_id"])
    # the entries meet the sources, which takes a shuffle; the texts they are found in do not
    found = attest.unlinked_entries(scrubbed, "doc_id", "doc_id", "analyst", F.lit("documents"), F.lit("HEAD"), F.lit(DETECTED_AT))
    named = found.drop("chain_id").join(sources, "payload", "left").withColumn("chain_id", F.coalesce("chain_id", F.lit("notes")))
    return named.select(*found.columns)


def attestation_chain_by_source(spark, sf) -> DataFrame:
    """One chain per source over all its documents."""
    return attest.linked_chain(_source_entries(spark, sf)).select("chain_id", "chain_seq", "entry_id", "file", "prev_hash", "this_hash")


def verify_chain_by_source(spark, sf) -> DataFrame:
    """Chains whose second half was linked in a later run, as written and with an edited entry (chain name with '!')."""
    entries = stored(_source_entries(spark, sf), "entries")
    early = F.col("payload") % 2 == 0
    first = attest.linked_chain(entries.where(early))
    later = attest.linked_chain(entries.where(~early), attest.chain_heads(first))
    good = first.unionByName(later).drop("payload", "place")
    edited = good.withColumn("chain_id", F.concat("chain_id", F.lit("!"))).withColumn(
        "token_placed", F.when(F.col("chain_seq") == 2, F.lit("[edited]")).otherwise(F.col("token_placed"))
    )
    return attest.verify_chain(good.unionByName(edited))


def pii_candidate_lines(spark, sf) -> DataFrame:
    return pii.pii_candidate_lines(rel.corpus_files(spark, sf))


def pii_scan_scope(spark, sf) -> DataFrame:
    files = rel.corpus_files(spark, sf).select("repo_id", pii.in_pii_scope(F.col("path")).alias("in_scope"))
    return files.groupBy("repo_id").agg(
        F.count_if("in_scope").alias("scanned"), F.count_if(~F.col("in_scope")).alias("skipped")
    )


def merge_pii_islands(spark, sf) -> DataFrame:
    return pii.pii_candidates(rel.corpus_files(spark, sf))


def phi_zones(spark, sf) -> DataFrame:
    return pii.phi_zones(pii.pii_candidates(rel.corpus_files(spark, sf)))


def _payloads(spark, sf) -> DataFrame:
    """A nested JSON payload per event."""
    events = rel.table(spark, sf, "events").select(
        F.col("event_id").alias("payload_id"),
        F.concat(
            F.lit('{"type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"notes":["user '),
            F.col("user_id").cast("string"), F.lit('",{"path":"/e/'), F.col("event_id").cast("string"),
            F.lit('","tags":["'), "event_type", F.lit('",["deep",1,null,true]]}]}'),
        ).alias("payload"),
    )
    return events


def _note_payloads(spark, sf) -> DataFrame:
    """A nested JSON payload per document and note: its text under a structural field, in an object and in an array of arrays."""
    texts = rel.pii_texts(spark, sf)
    body = F.struct("text", F.array(F.array(F.lit("x")), F.array(F.col("text"), F.lit("y"))).alias("list"), F.lit(None).cast("string").alias("none"))
    whole = F.struct(F.col("doc_id").alias("id"), F.col("text").alias("name"), body.alias("body"), F.lit(1.5).alias("n"), F.lit(True).alias("ok"))
    return texts.select(F.col("doc_id").alias("payload_id"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def walk_string_leaves(spark, sf) -> DataFrame:
    return json_leaves.walk_string_leaves(_payloads(spark, sf), "payload_id", "payload")


def scrub_json(spark, sf) -> DataFrame:
    """Payloads of all events (negative ids), documents and notes, scrubbed in place."""
    events = _payloads(spark, sf).select((-F.col("payload_id") - 1).alias("payload_id"), "payload")
    out = json_leaves.scrub_json(events.unionByName(_note_payloads(spark, sf)), ["payload_id"])
    paths = F.array_join(F.transform("detections", lambda d: F.concat(d["json_path"], F.lit("@"), d["start_pos"].cast("string"))), " ")
    return out.select("payload_id", "scrubbed", "payload_hash", F.size("detections").cast("long").alias("hits"), paths.alias("places"))


def json_purity(spark, sf) -> DataFrame:
    """Strings of the payloads, before scrubbing, that would stop a run."""
    return json_leaves.impure_leaves(_note_payloads(spark, sf), ["payload_id"], "payload")


QUERIES = {
    f.__name__: f
    for f in (
        counts_by_type, detect_pii, resolve_overlaps, build_token, scrub_value, structural_gate, detection_counts,
        uncertain_detections, purity_check, purity_after_scrub, line_of_match, attestation_chain, verify_chain,
        attestation_chain_by_source, verify_chain_by_source,
        pii_candidate_lines, pii_scan_scope, merge_pii_islands, phi_zones, walk_string_leaves, scrub_json, json_purity,
    )
}
