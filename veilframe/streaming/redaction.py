"""Redaction as Structured Streaming micro-batches.

A micro-batch holds every request that arrived since the last one; its strings are scored together.  The trigger
interval takes the part of a linger time.  The stage is stateless: no watermark, no keyed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.redact_payloads import redact_payloads
from ..plans.api import redact


def start_replies(payloads: DataFrame, out: str, checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    """Write replies of a payload stream as Parquet; ``once`` handles what is there and stops."""
    config = config or Config()
    writer = redact_payloads(payloads, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.linger_ms} milliseconds")
    return writer.start()


def start_redaction(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    """Hand each micro-batch of redacted documents to ``sink`` (batch, number); a small batch is spread over the cores."""
    config = config or Config()
    writer = docs.writeStream.foreachBatch(lambda batch, n: sink(redact(batch, config), n)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.linger_ms} milliseconds")
    return writer.start()
