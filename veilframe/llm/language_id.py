"""Language identification by multilingual mixture inference.

Every learned language has smoothed probabilities of hashed byte trigrams, counted over all labelled training
texts.  A document is a mixture of languages: each of its words comes from one language, drawn with
unknown proportions.  Expectation-maximisation estimates the proportions from the words'
trigram likelihoods, in rounds that go on until no proportions can be better by more than ``GAP`` (or ``MOST`` rounds have
run; what could still be gained is then known).  Sets of languages grow in the order of the estimated proportions, and the
set with the best likelihood less ``log(words) / 2`` per further language is kept; its largest share is the
prediction and that share the score.  Larger sets are tried only while the bound of the full mixture lets one win.

Counting runs per task in dense tables of fixed size (65,536 buckets a language) and merges them by sum,
so what is shuffled and collected depends on the number of languages, not of texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; where nothing was learned all
are; rows with null language or id do not train (a null id is predicted); ties go to the
language that sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import batches

BUCKETS = 1 << 16
ROUNDS = 8  # of all documents together; then each goes on by itself
MOST = 200
GAP = 1e-2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[:0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte, and which bytes are letters (non-ASCII bytes count)."""
    b = _FOLD[data]
    wide = np.full(len(b) + 2, 0x20, np.uint32)
    wide[1:-1] = b
    t = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    t *= np.uint32(0x9E3779B1)
    return (t >> np.uint32(16)).astype(np.int64), b != 0x20


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch, data, offs in batches(it):
        found: dict[str, list[np.ndarray]] = {}
        for lang, a, b in zip(batch.column(0).to_pylist(), offs[:-1], offs[1:], strict=True):
            bucket, letter = _trigrams(data[a:b])
            found.setdefault(lang, []).append(bucket[letter])
        for lang, parts in found.items():
            counts[lang] = counts.get(lang, 0) + np.bincount(np.concatenate(parts), minlength=BUCKETS)
    for lang, own in counts.items():
        hit = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(own[hit].astype(np.int64))], ["lang", "bucket", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (bucket x language) from all labelled rows of ``docs``."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    total = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(total["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[total["bucket"].to_numpy(np.int64), np.searchsorted(langs, total["lang"].to_numpy(str)) if langs else []] += total["n"].to_numpy(float)
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions of each group of rows among its allowed languages, and the log likelihood.

    ``like`` holds relative word likelihoods (best language: 1), groups are ``first[i]:first[i+1]``, none empty.
    """
    size = np.diff(first)
    group = np.repeat(np.arange(len(size)), size)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = like * share[group]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, first[:-1], axis=0) / size[:, None]
    mass = np.maximum((like * share[group]).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(mass), first[:-1])


def _settle(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, share: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions, log likelihood, and the most that any proportions of the allowed languages could add to it.

    The likelihood is concave, so its optimum is at most ``size * log(largest mean of like / mass)`` away.  A group stops
    when that is under ``GAP``, or when no proportions reach its ``enough``.
    """
    size = np.diff(first)
    share = share.astype(np.float64)
    fit, gap = np.zeros(len(size)), np.zeros(len(size))
    live, rows, cut = np.arange(len(size)), like, first
    for turn in range(MOST):
        own = size[live]
        mass = np.maximum((rows * np.repeat(share[live].astype(np.float32), own, axis=0)).sum(axis=1), np.float32(1e-30))
        fit[live] = np.add.reduceat(np.log(mass), cut[:-1], dtype=np.float64)
        pull = np.add.reduceat(rows / mass[:, None], cut[:-1], axis=0, dtype=np.float64) / own[:, None] * (allowed[live] > 0)
        gap[live] = own * np.log(np.maximum(pull.max(axis=1), 1))
        moving = gap[live] > GAP + 1e-6 * own  # rounding of single precision
        if enough is not None:
            moving &= fit[live] + gap[live] > enough[live]
        if not moving.any() or turn == MOST - 1:
            break
        if not moving.all():
            rows = rows[np.repeat(moving, own)]
            live, pull = live[moving], pull[moving]
            cut = np.r_[0, np.cumsum(size[live])]
        share[live] *= pull  # the EM step
        share[live] /= share[live].sum(axis=1, keepdims=True)
    return share, fit, gap


def infer(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Language shares of each group of words from word log likelihoods (words x languages)."""
    like = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)
    size = np.diff(first)
    n, langs = len(size), score.shape[1]
    alone = np.log(np.maximum(like, 1e-30))
    alone = np.add.reduceat(alone.astype(np.float64), first[:-1], axis=0)
    top = np.argmax(alone, axis=1)
    shares = np.zeros((n, langs))
    shares[np.arange(n), top] = 1
    value = alone[np.arange(n), top]
    if langs == 1:
        return shares
    cost = 0.5 * np.log(np.maximum(size, 2))
    every = np.ones((n, langs), np.float32)
    full, _ = _mixture(like, first, every)
    full, most, gap = _settle(like, first, every, full, value + cost)
    most += gap  # no mixture is likelier
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, langs + 1):
        open_ = np.flatnonzero(most - (k - 1) * cost > value)
        if not len(open_):
            break
        sub = like[np.repeat(np.isin(np.arange(n), open_), size)]
        cut = np.r_[0, np.cumsum(size[open_])]
        allowed = np.zeros((len(open_), langs), np.float32)
        np.put_along_axis(allowed, order[open_, :k], 1, axis=1)
        share, _ = _mixture(sub, cut, allowed)
        share, fit, _ = _settle(sub, cut, allowed, share)
        fit -= (k - 1) * cost[open_]
        better = fit > value[open_]
        shares[open_[better]] = share[better]
        value[open_[better]] = fit[better]
    return shares
    rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in open_])
    sub, cut = like[rows], np.r_[0, np.cumsum(size[open_])]
    order = np.argsort(-full[open_], axis=1, kind="stable")
    for k in range(2, langs + 1):
        allowed = np.zeros((len(open_), langs), np.float32)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        share, fit = _mixture(sub, cut, allowed)
        fit = fit - (k - 1) * cost[open_]
        better = fit > value[open_]
        shares[open_[better]] = share[better]
        value[open_[better]] = fit[better]
    return shares


def _languages(it: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with the language of each (its number, that of ``und`` last), score and shares."""
    for batch, data, offs in batches(it, text, most=max(1 << 16, (2 << 20) // max(1, len(langs)))):  # memory grows with languages
        lo, hi = int(offs[0]), int(offs[-1])
        n = batch.num_rows
        lang, score = np.full(n, len(langs)), np.zeros(n)
        shares = np.zeros((n, len(langs)))
        if hi > lo and langs:
            part, cut = data[lo:hi], offs - lo
            bucket, letter = _trigrams(part)
            inner = np.zeros(len(part) + 1, bool)
            inner[cut] = True
            start = np.flatnonzero(letter & (np.r_[True, ~letter[:-1]] | inner[:-1]))
            if len(start):
                value = np.where(letter[:, None], table[bucket], np.float32(0))
                score_w = np.add.reduceat(value, start, axis=0)
                first = np.searchsorted(start, cut)
                known = np.flatnonzero(np.diff(first))
                known = np.array([d for d in known if _has_letter(part, int(cut[d]), int(cut[d + 1]))], np.int64)
                if len(known):
                    rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in known])
                    shares[known] = infer(score_w[rows], np.r_[0, np.cumsum(np.diff(first)[known])])
                    lang[known] = np.argmax(shares[known], axis=1)
                    score[known] = shares[known].max(axis=1)
        yield batch, lang, score, shares


def _predict(it: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    langs, table = model.value
    names = np.array([*langs, "und"], object)
    for batch, lang, score, shares in _languages(it, langs, table):
        kept = [{langs[i]: float(s[i]) for i in np.flatnonzero(s > 0)} for s in shares]
        yield pa.record_batch([batch.column(0), pa.array(names[lang], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(kept, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "shares"])


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _has_letter(data: np.ndarray, a: int, b: int) -> bool:
    for at in range(a, b, 4096):
        if _ASCII_LETTER[data[at : min(at + 4096, b)]].any():
            return True
    return any(c.isalpha() for c in data[a:b].tobytes().decode("utf-8", "replace"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, shares (map of the selected languages)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda it: _predict(it, sent), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, shares map<string,double>")


def _known(it: Iterator[pa.RecordBatch], model, text: str) -> Iterator[pa.RecordBatch]:
    langs, table = model.value
    for batch, lang, _, _ in _languages(it, langs, table, text):
        yield batch.filter(pa.array(lang < len(langs)))


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which a language is found, all columns as they are; ``text_col`` is a string."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _known(it, sent, text_col), docs.schema)


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m
