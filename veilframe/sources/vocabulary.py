"""Rank files: one base64 token and its rank per line."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _own_file(path: str) -> list[tuple[bytes, int]] | None:
    """Tokens and ranks of a file that the driver sees itself, as one of a Python package: executors or the default file system may not have it."""
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        parts = [line.split(b" ") for line in f.read().split(b"\n")]
    return [(base64.b64decode(p[0]), int(p[1])) for p in parts if len(p) == 2]


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """token (binary), rank: the file as a table; lines without both parts are skipped."""
    own = _own_file(path)
    if own is not None:
        return spark.createDataFrame(pa.table({"token": pa.array([t for t, _ in own], pa.binary()), "rank": pa.array([r for _, r in own], pa.int32())}))
    parts = F.split("value", " ")
    rows = spark.read.option("lineSep", "\n").text(path).where(F.size(parts) == 2)
    return rows.select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary; its size is that of the file, not of the data."""
    own = _own_file(path)
    return dict(own) if own is not None else {bytes(r["token"]): r["rank"] for r in rank_table(spark, path).collect()}
