"""The operators over the shared tables, with production parameters, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import centroids, decontaminate, divergence, fingerprints, langid, line_dedup, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts, toxicity
from factloom.llm.sampling import fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).withColumn("held_out", held_out)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)
    return out.withColumnsRenamed({"tox_score": "score", "tox_predicted": "predicted"})


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.compression_bands(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(_read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.prefix_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]).drop("token_steps")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents")).drop("representative", "text_hash")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    model = quality_classifier.fit(docs, _read(spark, sf_dir, "labels"), ~held_out)
    out = quality_classifier.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out)
    return out.withColumnsRenamed({"quality_score": "score", "quality_predicted": "predicted"})


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_read(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"), k=40, rounds=5)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_packing, op3_toxicity, op4_quality_rules, op5_sharding, op6_line_dedup, op7_token_counts, op8_ngram_jaccard_join, op9_decontamination, op10_quality_classifier,
    op11_source_divergence, op12_document_fingerprints, op13_centroid_clustering)}


def _clusters_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every vector against every centroid in every round."""
    near = """a{t} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'j': j}}) AS b FROM (
  SELECT r, vec_id, v, j, list_sum(list_transform(range(1, {e}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{t}) GROUP BY r)"""
    move = """c{n} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN (
  SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (SELECT b.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, range(1, {e}) g(i) GROUP BY 1, 2) GROUP BY j) m USING (j))"""
    steps = []
    for t in range(rounds):
        steps += [near.format(t=t, e=dims + 1), move.format(t=t, n=t + 1, e=dims + 1)]
    steps.append(near.format(t=rounds, e=dims + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT n - 1 AS j, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) AS n FROM kept) WHERE n <= {k}),
""" + ",\n".join(steps) + f"""
SELECT vec_id, b.j::INTEGER AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.j)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON b.j = c{rounds}.j"""


#: op8: all pairs that share a shingle, then labels spread along links; op11: every term for every pair of sources.  For small
#: tables, which is where the check runs
ORACLES = {
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM classes LEFT JOIN sizes USING (doc_id)""",
    "op11_source_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n, count(*) OVER (PARTITION BY lang) AS v FROM found GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
lang_p AS (SELECT lang, term, n, v, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM kept),
uses AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT lang, source, term, coalesce(u.n, 0) AS n, q, v FROM groups JOIN lang_p USING (lang) LEFT JOIN uses u USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS f FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f
  ON f.lang = a.lang AND f.s1 = a.source AND f.s2 = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10""",
    "op13_centroid_clustering": _clusters_sql(),
}
