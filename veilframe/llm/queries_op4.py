"""op4: exact deduplication of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import name_documents


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT body, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM n GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM n JOIN g USING (body)
"""
