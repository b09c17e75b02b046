"""Corpus preparation as a list of stages over ``documents``.

Language ID rejects texts without a language (no letters); line dedup takes cross-site boilerplate out of texts;
near-dedup keeps the smallest id of each component (and texts without words); decontamination drops documents
that hold benchmark passages; the last stage encodes what is left and checks the round trip.
All stages but the last return the columns of ``documents``, under their names whatever these are.

Languages and lines are judged row by row.  In near-dedup and decontamination rows of one id are one document: they stay
or go together; rows with a null id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontamination, language_id, line_dedup, near_dedup
from veilframe.llm.queries_op6 import tokenizer_file
from veilframe.llm.tables import fresh, materialise
from veilframe.shipping import ship


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows of the given ids (one column); rows with a null id stay."""
    key = fresh("gone", docs.columns)
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(key), "left_anti")


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found; the model learns from their labelled rows."""
    ship(spark)
    return language_id.with_language(docs, language_id.learn(docs))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take widespread lines out of texts; every document stays."""
    ship(spark)
    out = line_dedup.remove_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component (five-word shingles, similarity 0.8)."""
    ship(spark)
    return _without(docs, near_dedup.near_duplicates(docs, n=5, percent=80).where("not kept").select("id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    ship(spark)
    return _without(docs, decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("id"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and whether they decode to the text."""
    ship(spark)
    return bpe.encode(docs, tokenizer_file(), check=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", detect_language),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("template_decontamination", drop_contaminated),
    ("bpe", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:  # stages read their input several times
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
