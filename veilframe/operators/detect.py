"""Detection in one narrow stage: tokens, windows, scores, labels, runs, snapped and trimmed spans, selection, masks.

Log probabilities never become a column unless they are asked for: 33 floats a token stay inside the task.  Documents are
independent, so there is no shuffle and any partitioning gives the same result.

Texts travel as bytes.  A byte that starts no valid UTF-8 sequence is scored as U+FFFD and stays as it is in every
result; offsets are those of the bytes given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..schema import CATEGORIES, N_LABELS
from . import span_lists
from .decode import argmax_labels, label_runs, viterbi
from .rules import RuleScorer
from .text_bytes import readable, snap, trim
from .tokens import Tokenizer, tokenizer

#: texts, token ids and token boundaries of some documents -> log probabilities, one row per token
Scorer = Callable[[list[str], list[np.ndarray], list[np.ndarray]], np.ndarray]
CHUNK_BYTES = 1 << 20


class RunStats(NamedTuple):
    """Sums over all tasks of a run; a task that is run again counts again."""

    docs: Accumulator
    tokens: Accumulator
    batches: Accumulator
    tokenize_s: Accumulator
    forward_s: Accumulator
    decode_s: Accumulator

    @staticmethod
    def of(spark: SparkSession) -> RunStats:
        make = spark.sparkContext.accumulator
        return RunStats(make(0), make(0), make(0), make(0.0), make(0.0), make(0.0))

    def __str__(self) -> str:
        docs, tokens, batches, *seconds = (a.value for a in self)
        rate = tokens / seconds[1] if seconds[1] else 0.0
        return f"load+tokenize {1e3 * seconds[0]:.0f}ms | {docs} docs, {tokens} tok, {batches} batches | forward {1e3 * seconds[1]:.0f}ms ({rate:.1f} tok/s) | decode {1e3 * seconds[2]:.1f}ms"


def raw_spans(texts: list[str], tok: Tokenizer, scorer: Scorer, config: Config, stats: RunStats | None = None) -> list[list[dict]]:
    """Spans of each text before selection, in bytes of its UTF-8 form.

    Texts of which the scorer knows without tokens that it finds nothing (``silent``) are not scored.  Where it knows the
    bytes at which its spans begin and end (``cuts``), tokens are cut there, so that no span takes more than that.
    """
    out: list[list[dict]] = [[] for _ in texts]
    silent = getattr(scorer, "silent", None)
    open_ = [i for i, t in enumerate(texts) if not (silent and silent(t))]
    began = time.perf_counter()
    coded = [tok.encode(texts[i], getattr(scorer, "needs_ids", True)) for i in open_]
    ids, bounds = [c[0] for c in coded], [c[1] for c in coded]
    n_tokens = sum(map(len, ids))
    if cuts := getattr(scorer, "cuts", None):
        whole, bounds = bounds, [np.union1d(b, cuts(texts[i])) for i, b in zip(open_, bounds, strict=True)]
        ids = [i[np.searchsorted(w, b[:-1], side="right") - 1] for i, w, b in zip(ids, whole, bounds, strict=True)]
    offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int64)
    before = getattr(scorer, "batches", 0)
    ready = time.perf_counter()
    lp = scorer([texts[i] for i in open_], ids, bounds)
    scored = time.perf_counter()
    labels = argmax_labels(lp) if config.argmax else viterbi(lp, offsets)
    cats, first, last = label_runs(labels, offsets)
    doc = np.searchsorted(offsets, first, side="right") - 1
    data: dict[int, bytes] = {}
    for d, c, a, b in zip(doc.tolist(), cats.tolist(), first.tolist(), last.tolist(), strict=True):
        raw = data.get(d)
        if raw is None:
            raw = data[d] = texts[open_[d]].encode("utf-8", "surrogatepass")
        start, end = trim(raw, *snap(raw, int(bounds[d][a - offsets[d]]), int(bounds[d][b - offsets[d] + 1])))
        if end > start:
            out[open_[d]].append({"label": CATEGORIES[c], "start": start, "end": end})
    if stats is not None:
        for a, x in zip(stats, (len(texts), n_tokens, getattr(scorer, "batches", 1) - before, ready - began, scored - ready, time.perf_counter() - scored), strict=True):
            a.add(x)
    return out


def spans_of(data: list[bytes], tok: Tokenizer, scorer: Scorer, config: Config, stats: RunStats | None = None) -> list[list[dict]]:
    """Spans of each text before selection, in bytes of the text as given."""
    texts, places = zip(*map(readable, data), strict=True) if data else ((), ())
    out = raw_spans(list(texts), tok, scorer, config, stats)
    for spans, at in zip(out, places, strict=True):
        if at is not None:
            for s in spans:
                s["start"], s["end"] = int(at[s["start"]]), int(at[s["end"]])
    return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Values of a binary column in runs of about CHUNK_BYTES, with the place of each run."""
    lo = size = 0
    part: list[bytes | None] = []
    for hi, x in enumerate(column):
        part.append(x.as_py())
        size += len(part[-1] or b"")
        if size > CHUNK_BYTES or hi == len(column) - 1:
            yield lo, part
            lo, size, part = hi + 1, 0, []


def _detect(it: Iterator[pa.RecordBatch], ranks, config: Config, make_scorer: Callable[[Config], Scorer], what: str, stats: RunStats | None) -> Iterator[pa.RecordBatch]:
    tok, scorer = tokenizer(ranks, config.specials), make_scorer(config)
    for batch in it:
        for lo, data in chunks(batch.column(1)):
            spans = spans_of([x or b"" for x in data], tok, scorer, config, stats)
            if what != "raw":
                spans = [span_lists.select(s, config.span_cap) for s in spans]
            ids = batch.column(0).slice(lo, len(data))
            if what == "masked":
                yield pa.record_batch([ids, pa.array([x if not s else span_lists.mask_bytes(x, s) for x, s in zip(data, spans, strict=True)], pa.binary())], ["doc_id", "masked"])
            else:
                yield pa.record_batch([ids, batch.column(1).slice(lo, len(data)), pa.array(spans, _SPANS)], ["doc_id", "text", "found"])


def rule_scorer(config: Config) -> Scorer:
    return RuleScorer(config.rules)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))


def detected(docs: DataFrame, config: Config, ranks: dict[bytes, int] | None = None, make_scorer: Callable[[Config], Scorer] = rule_scorer, what: str = "spans", stats: RunStats | None = None) -> DataFrame:
    """doc_id, text and the spans of each text: as decoded (``raw``) or selected (``spans``); doc_id and ``masked`` text."""
    rows = _rows(docs)
    sent = docs.sparkSession.sparkContext.broadcast(ranks) if ranks is not None else None
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rest = "masked binary" if what == "masked" else "text binary, found array<struct<label:string,start:int,end:int>>"
    out = rows.mapInArrow(lambda it: _detect(it, sent, config, make_scorer, what, stats), f"doc_id {id_type}, {rest}")
    if what == "masked":
        return out.select("doc_id", F.col("masked").cast("string").alias("masked"))
    return out.select("doc_id", F.col("text").cast("string").alias("text"), F.col("found").alias(what))


def detect_raw(docs: DataFrame, config: Config, ranks: dict[bytes, int] | None = None, make_scorer: Callable[[Config], Scorer] = rule_scorer) -> DataFrame:
    """doc_id, text, raw: spans as decoded, before selection."""
    return detected(docs, config, ranks, make_scorer, "raw")


def _logprobs(it: Iterator[pa.RecordBatch], ranks, config: Config, make_scorer: Callable[[Config], Scorer]) -> Iterator[pa.RecordBatch]:
    tok, scorer = tokenizer(ranks, config.specials), make_scorer(config)
    for batch in it:
        for lo, data in chunks(batch.column(1)):
            texts = [readable(x or b"")[0] for x in data]
            ids, bounds = zip(*map(tok.encode, texts), strict=True)
            lp = scorer(texts, list(ids), list(bounds)).astype(np.float32)
            cut = pa.array(np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(lp) + 1, dtype=np.int32) * N_LABELS), pa.array(lp.ravel()))
            yield pa.record_batch([batch.column(0).slice(lo, len(data)), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(ids).astype(np.int32))), pa.ListArray.from_arrays(cut, values)], ["doc_id", "ids", "lp"])


def logprobs(docs: DataFrame, config: Config, ranks: dict[bytes, int] | None = None, make_scorer: Callable[[Config], Scorer] = rule_scorer) -> DataFrame:
    """doc_id, ids, lp: the tokens of each text and their log probabilities."""
    rows = _rows(docs)
    sent = docs.sparkSession.sparkContext.broadcast(ranks) if ranks is not None else None
    return rows.mapInArrow(lambda it: _logprobs(it, sent, config, make_scorer), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, lp array<array<float>>")


def _decode(it: Iterator[pa.RecordBatch], argmax: bool) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if not batch.num_rows:
            continue
        rows = batch.column(1)
        size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(rows), 0)).astype(np.int64)
        offsets = np.r_[0, np.cumsum(size)]
        lp = np.asarray(rows.flatten().flatten(), np.float32).reshape(-1, N_LABELS)
        labels = argmax_labels(lp) if argmax else viterbi(lp, offsets)
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(labels.astype(np.int32)))], ["doc_id", "lab"])


def decode_labels(scored: DataFrame, argmax: bool = False) -> DataFrame:
    """doc_id, lab: labels of documents whose log probabilities are given (doc_id, lp); a null lp has no labels."""
    rows = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lp").cast("array<array<float>>").alias("lp"))
    return rows.mapInArrow(lambda it: _decode(it, argmax), "doc_id long, lab array<int>")
