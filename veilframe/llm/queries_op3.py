"""op3: near-duplicate components over two-word shingles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dedup import near_duplicates


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), seen AS (
  SELECT g, count(*) AS c FROM s GROUP BY g
), ranked AS (
  SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY c, s.g) AS r FROM s JOIN seen USING (g) JOIN n USING (doc_id)
), lead AS (
  SELECT doc_id, g, n FROM ranked WHERE r <= n - ceil(0.8 * n) + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM lead a JOIN lead b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), hit AS (
  SELECT a, b, count(*) AS i FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b
), link AS (
  SELECT a, b FROM hit JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), root AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n.n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN root USING (doc_id)
"""
