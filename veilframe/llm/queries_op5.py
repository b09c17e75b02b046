"""op5: toxicity of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import remainder
from .toxicity import learn, score


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    out = score(docs, learn(docs, labels))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
