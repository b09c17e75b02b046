"""Set up a session for Python stages: the package on every executor, Arrow batches bounded in bytes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors and bound Arrow batches, once per application.

    Rows are texts of any length, so a batch of a fixed number of rows can be large; its bytes are limited instead.
    """
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="veilframe-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _done.add(app)
