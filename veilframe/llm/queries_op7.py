"""op7: predicted language of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import identify, learn, remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(remainder("doc_id", 3) != 1))
    return identify(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
