"""The thin contract queries over the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsar.llm.embedding_dedup import embedding_near_duplicates
from impulsar.llm.fingerprints import fingerprint_documents
from impulsar.llm.license_scan import license_sql, scan_licenses
from impulsar.llm.mixing import mix
from impulsar.llm.ngram_jaccard import ngram_jaccard_components
from impulsar.llm.secret_scan import BASE_KINDS, joined, scan_secrets
from impulsar.llm.sentencepiece_codec import decode, encode
from impulsar.llm.substring_dedup import remove_repeated_passages
from impulsar.llm.token_counts import count_tokens
from impulsar.llm.toxicity import fold, score_toxicity, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), count_links=True)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.base64("fingerprint")).withColumn("edited_fingerprint", F.base64("edited_fingerprint"))


def _of_kinds(*kinds: str):
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    counted = [F.size(_of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    base = joined(_of_kinds(*BASE_KINDS))
    return found.select("doc_id", *counted, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode(encode(docs))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op7_license_scan": license_sql(),
    # All pairs of documents that share a shingle; components by repeated minimum over the links.
    "op1_ngram_jaccard": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents d JOIN comp ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) l ON l.u = d.doc_id""",
    # All pairs of a label by exact cosine; components by repeated minimum over the links.
    "op2_embedding_dedup": """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, CAST(count(l.v) AS BIGINT) AS n_links, any_value(c.component_id) AS component_id,
       e.vec_id = any_value(c.component_id) AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id LEFT JOIN links l ON l.u = e.vec_id
GROUP BY e.vec_id""",
    "op3_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM wins GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i FROM wins JOIN firsts USING (k) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM docs WHERE doc_id IN (SELECT doc_id FROM per)),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(per.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN per.n IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM docs d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}
