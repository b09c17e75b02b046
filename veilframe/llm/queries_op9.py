"""op9: documents that hold benchmark passages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contaminated


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "first_token")
