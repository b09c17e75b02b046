"""Registered queries of the de-identification engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_numeric, queries_pipeline, queries_text
from .api import redact


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked text of every document."""
    return redact(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "masked", F.octet_length("masked").alias("n_bytes"))


QUERIES = queries_text.QUERIES | queries_numeric.QUERIES | queries_pipeline.QUERIES
ORACLES = queries_text.ORACLES | queries_numeric.ORACLES | queries_pipeline.ORACLES
