"""Requests to replies: route, walk, detect, mask, splice.  Stateless, so batch and streaming DataFrames both work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Config
from . import span_lists
from .detect import Scorer, raw_spans, rule_scorer
from .payload import ADAPTERS, Field, InvalidJson, find_fields, splice
from .tokens import tokenizer

MAX_BODY = 64 << 20

# Replies without a payload.
HEALTHY, UNKNOWN, INVALID, TOO_LARGE = b'{"status":"ok"}', b'{"error":"unknown route"}', b'{"error":"invalid JSON"}', b'{"error":"payload too large"}'


def reply(method: str | None, route: str | None, body: bytes, strict: bool) -> tuple[int, bytes, list[Field]]:
    """Status, body to send as it is, and the strings to mask (if any) of one request."""
    if method == "GET":
        return 200, HEALTHY, []
    if len(body) > MAX_BODY:
        return 413, TOO_LARGE, []
    if method != "POST" or route not in ADAPTERS:
        return 404, UNKNOWN, []
    try:
        return 200, body, find_fields(body, ADAPTERS[route], strict)
    except InvalidJson:
        return 400, INVALID, []


def well_formed(value: str) -> str:
    """The text that is scored: lone surrogates, which no encoder takes, as replacement characters of the same width."""
    return "".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in value)


def _redact(it: Iterator[pa.RecordBatch], ranks, config: Config, make_scorer: Callable[[Config], Scorer], strict: bool) -> Iterator[pa.RecordBatch]:
    tok, scorer = tokenizer(ranks, config.specials), make_scorer(config)
    for batch in it:
        replies = [reply(m, r, b or b"", strict) for m, r, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        texts = [f.value for _, _, fields in replies for f in fields]  # strings of all requests are scored together
        masked = iter(v if not s else span_lists.mask(v, s) for v, s in zip(texts, (span_lists.select(s, config.span_cap) for s in raw_spans([well_formed(t) for t in texts], tok, scorer, config)) if texts else (), strict=True))
        out = [(code, splice(body, fields, [next(masked) for _ in fields]) if fields else body) for code, body, fields in replies]
        yield pa.record_batch([batch.column(0), pa.array([c for c, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["payload_id", "status", "body"])


def redact_payloads(payloads: DataFrame, config: Config | None = None, ranks: dict[bytes, int] | None = None, make_scorer: Callable[[Config], Scorer] | None = None, strict: bool = False) -> DataFrame:
    """payload_id, status, body for rows (payload_id, method, route, body)."""
    from ..plans.api import prepared

    config = config or Config()
    if ranks is None:
        ranks, make_scorer = prepared(payloads.sparkSession, config, make_scorer)
    make_scorer = make_scorer or rule_scorer
    sent = payloads.sparkSession.sparkContext.broadcast(ranks) if ranks is not None else None
    return payloads.select("payload_id", "method", "route", "body").mapInArrow(lambda it: _redact(it, sent, config, make_scorer, strict), "payload_id string, status int, body binary")
