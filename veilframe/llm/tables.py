"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

An operator that needs a result twice, or wants to cut lineage, writes it as Parquet there and
reads it back.  A lost executor then costs a task retry, never the table.  Tables that later
steps no longer need are dropped at once; the rest go when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on one machine a new temporary one.

    On a cluster the setting is required: executors cannot share a folder of their own machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; the shuffle files behind it are freed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(_CLEANUP, before)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._veilframe_path = path
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or it with underscores after it, so that no column of ``taken`` has it (case aside)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` whose readers are done."""
    for t in tables:
        path = getattr(t, "_veilframe_path", None)
        if path and _kept.pop(path, None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_kept.items()):
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _delete(spark, path)
    _kept.clear()
