"""Documents from arguments, files, lines, standard input and request payloads."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DOCS

PAYLOAD = T.StructType([T.StructField("payload_id", T.StringType()), T.StructField("method", T.StringType()), T.StructField("route", T.StringType()), T.StructField("body", T.BinaryType())])


def from_words(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    """One document: the words joined by one space; bytes of arguments that are no UTF-8 stay."""
    return _of_bytes(spark, [" ".join(words).encode("utf-8", "surrogateescape")])


def _of_bytes(spark: SparkSession, texts: list[bytes]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))


def from_stdin(spark: SparkSession, lines: bool = False) -> DataFrame:
    """One document, or one per line, bytes as they are; empty input gives no document."""
    data = sys.stdin.buffer.read()
    if not data:
        return spark.createDataFrame([], DOCS)
    if not lines:
        return _of_bytes(spark, [data])
    parts = data.split(b"\n")
    return _of_bytes(spark, parts[:-1] if parts[-1] == b"" else parts)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text, valid: one document per file, bytes kept as they are; ``valid`` marks proper UTF-8."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").cast("string").alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def line_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: one document per line; only a line feed ends a line, and a last one adds no document.

    Ids grow in file order and are unique, not dense: numbering rows would take a pass of its own.
    """
    return spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: the lines of each text, as ``line_files`` cuts them; null and empty texts have none."""
    parts = F.split("text", "\n", -1)
    n = F.size(parts)
    body = F.when(F.col("text").isNull() | (F.col("text") == ""), F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)
    return docs.select("doc_id", F.posexplode(body).alias("line_no", "line"))


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of request payloads from a folder of JSON files (payload_id, method, route, body in base64)."""
    schema = "payload_id string, method string, route string, body string"
    return spark.readStream.schema(schema).json(path).select("payload_id", "method", "route", F.unbase64("body").alias("body"))
