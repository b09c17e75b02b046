"""op10: cross-site boilerplate lines of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import MIN_SITES, MIN_WORDS, removals, without_lines


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    gone = removals(docs).withColumnRenamed("id", "doc_id")
    out = docs.withColumn("row", F.xxhash64("text")).join(gone, ["doc_id", "row"], "left")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce(without_lines(F.col("text"), F.col("gone")), F.lit("")), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH parts AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS i, ls FROM parts
), t AS (
  SELECT doc_id, source, i, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
), c AS (
  SELECT * FROM t WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS}
), wide AS (
  SELECT line, min(doc_id) AS low FROM c GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT doc_id, list(i) AS ks FROM c JOIN wide USING (line) WHERE doc_id <> low GROUP BY doc_id
), k AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS ls, ks, d.text FROM documents d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN list_contains(ks, i) THEN NULL ELSE ls[i] END), lambda x: x IS NOT NULL), chr(10)), '') END) AS kept_sha256 FROM k
"""
