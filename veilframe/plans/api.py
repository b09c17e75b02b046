"""Detect and redact: the pipeline as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.spans import byte_slice, spans_json
from ..operators import detect as engine
from ..operators.detect import RunStats, Scorer
from ..operators.partitioning import spread
from ..sources.checkpoint import scorer_of, share_weights, vocabulary_of
from ..sources.vocabulary import read_ranks

MakeScorer = Callable[[Config], Scorer]


def prepared(spark: SparkSession, config: Config, make_scorer: MakeScorer | None = None) -> tuple[dict[bytes, int] | None, MakeScorer]:
    """Vocabulary and scorer of a run: those of the checkpoint where ``config.model`` names one, else the rules."""
    if make_scorer is None and config.model:
        share_weights(spark, config.model)
    path = vocabulary_of(config)
    return read_ranks(spark, path) if path else None, make_scorer or scorer_of(config)


def _run(docs: DataFrame, config: Config | None, make_scorer: MakeScorer | None, what: str, stats: RunStats | None) -> DataFrame:
    config = config or Config()
    ranks, scorer = prepared(docs.sparkSession, config, make_scorer)
    return engine.detected(spread(docs), config, ranks, scorer, what, stats)


def detect(docs: DataFrame, config: Config | None = None, make_scorer: MakeScorer | None = None, stats: RunStats | None = None) -> DataFrame:
    """doc_id, text, spans: selected spans of each document with byte offsets."""
    return _run(docs, config, make_scorer, "spans", stats)


def redact(docs: DataFrame, config: Config | None = None, make_scorer: MakeScorer | None = None, stats: RunStats | None = None) -> DataFrame:
    """doc_id, masked: each text with placeholders for its spans, all other bytes as they are."""
    return _run(docs, config, make_scorer, "masked", stats)


def span_records(docs: DataFrame, config: Config | None = None, make_scorer: MakeScorer | None = None, stats: RunStats | None = None) -> DataFrame:
    """doc_id, json: each document's spans as one JSON object."""
    return detect(docs, config, make_scorer, stats).select("doc_id", spans_json(F.coalesce("text", F.lit("")), F.col("spans")).alias("json"))


def logprobs(docs: DataFrame, config: Config | None = None, make_scorer: MakeScorer | None = None) -> DataFrame:
    """doc_id, ids, lp: tokens of each document and their log probabilities."""
    config = config or Config()
    ranks, scorer = prepared(docs.sparkSession, config, make_scorer)
    return engine.logprobs(spread(docs), config, ranks, scorer)


def with_texts(found: DataFrame) -> DataFrame:
    """``detect``'s result with the text of every span."""
    return found.withColumn("spans", F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), byte_slice(F.col("text"), s["start"], s["end"]).alias("text"))))
