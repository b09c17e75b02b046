"""op2: language-model scores of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import train_and_score
from .language_id import remainder


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda c: F.coalesce(remainder(c, 7) == 2, F.lit(False))
    out = train_and_score(docs, ~held("doc_id"))
    return out.select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
