"""Spread input over the cores where its files do not."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions than that, as one small file does; else unchanged.

    Such input is at most a few splits, so the shuffle is small; large inputs are read as they lie.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
