"""op1: substring deduplication over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substring_dedup import dedup_substrings


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM p
), m AS (
  SELECT win, min(doc_id) AS low FROM g GROUP BY win
), c AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS k FROM g JOIN m USING (win) WHERE m.low < g.doc_id
), gone AS (
  SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
         CASE WHEN ks IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN list_contains(ks, i) THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) END AS ks2
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(ks2, ' ')) AS kept_sha256 FROM kept
"""
