"""Substring deduplication: seed and extend over winnowed anchors.

A window is ``length`` consecutive words.  A word goes when some window over it also starts in a
document with a smaller id; windows are judged on the input.

Seeds.  Winnowing takes, in every window, the rightmost smallest of its ``length - k + 1`` k-gram
hashes as its anchor.  Equal windows have their anchor at the same place, so documents that share a
window share an anchor: joining documents on anchors finds every repeat of at least ``length`` words.

Extension.  The windows that chose an anchor form one stretch of text around it, its
neighbourhood, reaching at most ``length - k`` words to either side.  If the whole
neighbourhood occurs in an earlier document, the match extends over it both ways and all its words go.
Where neighbourhoods of one anchor differ (the ends of a maximal repeat), their windows are compared
one by one.  A maximal repeat over the threshold is the union of such matches.

No pairs are made: occurrences of an anchor, neighbourhood or window meet in a partially aggregated
``min(doc_id)``, so one passage in a third of all documents costs one row per task, and joins back
run on plain tables, where adaptive execution splits a skewed key.

Edge cases: null or empty text has no words; texts below ``length`` words lose nothing; a null id
never repeats anything and nothing repeats it; rows with the same id do not repeat each other; equal
rows all come back; extra columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialise
from .textkernel import U64, Words, as_text, batches, grams, mix64, odd_constants, signed, words

LENGTH = 13
K = 5


def _chosen(w: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, the word at which its anchor starts, and all k-gram hashes."""
    g = grams(w.hash, k, 1)
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    doc = w.document()
    span = length - k + 1
    low = g[:n].copy()
    for j in range(1, span):
        np.minimum(low, g[j : j + n], out=low)
    at = np.empty(n, np.int64)
    for j in range(span):
        hit = np.flatnonzero(g[j : j + n] == low)
        at[hit] = hit + j
    start = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return start, at[start], g


def _anchors(it: Iterator[pa.RecordBatch], length: int, k: int, full: bool) -> Iterator[pa.RecordBatch]:
    power = np.ones(1, U64)
    base, back = U64(0x9FB21C651E98DF25), U64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
    inverse = power
    for batch, data, offs in batches(it):
        w = words(data, offs)
        start, at, g = _chosen(w, length, k)
        if not len(start):
            continue
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # windows of one anchor stand together
        pos = at[first]
        doc = np.searchsorted(w.first, pos, side="right") - 1
        ids = batch.column(0).take(pa.array(doc))
        if not full:
            yield pa.record_batch([pa.array(signed(g[pos])), ids], ["anchor", "id"])
            continue
        n = len(w.hash)
        if len(power) <= n:
            power = np.cumprod(np.r_[U64(1), np.full(n, base, U64)])
            inverse = np.cumprod(np.r_[U64(1), np.full(n, back, U64)])
        total = np.r_[U64(0), np.cumsum(w.hash * power[:n])]
        lo = start[first]
        hi = start[np.r_[first[1:], len(start)] - 1] + length
        hood = mix64((total[hi] - total[lo]) * inverse[lo] + (pos - lo).astype(U64) * U64(0x9E3779B97F4A7C15) + (hi - lo).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        yield pa.record_batch(
            [pa.array(signed(g[pos])), pa.array(signed(hood)), ids, batch.column(1).take(pa.array(doc)), pa.array((pos - w.first[doc]).astype(np.int32))],
            ["anchor", "hood", "id", "row", "pos"],
        )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.zeros(n, np.int64) if not n else np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.asarray(column.flatten()), np.r_[0, np.cumsum(sizes)]


def _windows(it: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Identities (128 bits) of the windows whose anchors are listed in ``pos``."""
    for batch, data, offs in batches(it):
        w = words(data, offs)
        start, at, _ = _chosen(w, length, k)
        value, cut = _lists(batch.column(batch.schema.get_field_index("pos")))
        flag = np.zeros(len(w.hash) + 1, bool)
        flag[value + np.repeat(w.first[:-1], np.diff(cut))] = True
        start = start[flag[at]]
        if not len(start):
            continue
        doc = np.searchsorted(w.first, start, side="right") - 1
        yield pa.record_batch(
            [
                pa.array(signed(grams(w.hash, length, 2)[start])),
                pa.array(signed(grams(w.hash, length, 3)[start])),
                batch.column(0).take(pa.array(doc)),
                batch.column(1).take(pa.array(doc)),
                pa.array((start - w.first[doc]).astype(np.int32)),
            ],
            ["h1", "h2", "id", "row", "start"],
        )


def _removed(it: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Kept text and the removed stretches of words."""
    for batch, data, offs in batches(it):
        w = words(data, offs)
        total = len(w.hash)
        delta = np.zeros(total + 1, np.int64)
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        value, cut = _lists(col("pos"))
        if len(value):
            start, at, _ = _chosen(w, length, k)
            flag = np.zeros(total + 1, bool)
            flag[value + np.repeat(w.first[:-1], np.diff(cut))] = True
            np.add.at(delta, start[flag[at]], 1)
            np.add.at(delta, start[flag[at]] + length, -1)
        value, cut = _lists(col("starts"))
        if len(value):
            s = value + np.repeat(w.first[:-1], np.diff(cut))
            np.add.at(delta, s, 1)
            np.add.at(delta, s + length, -1)
        gone = np.cumsum(delta[:-1]) > 0
        many = np.r_[0, np.cumsum(gone)]
        texts, spans = [], []
        for d in range(batch.num_rows):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            whole = data[offs[d] : offs[d + 1]].tobytes().split()
            if many[hi] == many[lo]:
                texts.append(b" ".join(whole))
                spans.append([])
                continue
            keep = ~gone[lo:hi]
            texts.append(b" ".join([whole[i] for i in np.flatnonzero(keep)]))
            inner = np.diff(np.r_[False, ~keep, False].astype(np.int8))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(inner == 1), np.flatnonzero(inner == -1), strict=True)])
        yield pa.record_batch(
            [
                batch.column(0),
                as_text(texts),
                pa.array(np.diff(w.first)),
                pa.array(many[w.first[1:]] - many[w.first[:-1]]),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            ["id", "kept_text", "n_words", "n_removed", "spans"],
        )


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """One row per row of ``docs``: id, kept_text, n_words, n_removed, spans (word ranges that went)."""
    if not 1 <= k <= length:
        raise ValueError("k must lie between 1 and length")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    known = rows.where("id is not null")
    id_type = rows.schema["id"].dataType.simpleString()

    seeds = (
        known.mapInArrow(lambda it: _anchors(it, length, k, False), f"anchor long, id {id_type}")
        .groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    )
    seeds = materialise(seeds, "op1-seeds")
    found = known.mapInArrow(lambda it: _anchors(it, length, k, True), f"anchor long, hood long, id {id_type}, row long, pos int")
    found = materialise(found.join(seeds, "anchor", "left_semi"), "op1-occurrences")
    drop(seeds)

    hoods = materialise(found.groupBy("anchor", "hood").agg(F.min("id").alias("low")), "op1-hoods")
    several = hoods.groupBy("anchor").agg(F.min("hood").alias("a"), F.max("hood").alias("b")).where("a < b").select("anchor", F.lit(True).alias("several"))
    several = materialise(several, "op1-several")  # a table of its own, so that the join can split an anchor of many neighbourhoods
    marked = materialise(hoods.join(several, "anchor", "left"), "op1-marked")
    drop(hoods, several)
    state = F.when(F.col("low") < F.col("id"), 1).when(F.col("several"), 2)
    spots = (
        found.join(marked, ["anchor", "hood"]).select("id", "row", "pos", state.alias("state")).where("state is not null")
        .groupBy("id", "row").agg(F.collect_list(F.when(F.col("state") == 1, F.col("pos"))).alias("pos"), F.collect_list(F.when(F.col("state") == 2, F.col("pos"))).alias("open"))
    )
    spots = materialise(spots, "op1-spots")
    drop(found, marked)

    parts = known.join(spots.where("size(open) > 0").select("id", "row", F.col("open").alias("pos")), ["id", "row"]).select("id", "row", "text", "pos")
    parts = materialise(parts.mapInArrow(lambda it: _windows(it, length, k), f"h1 long, h2 long, id {id_type}, row long, start int"), "op1-windows")
    lows = materialise(parts.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h1", "h2", "low"), "op1-lows")
    ends = parts.join(lows, ["h1", "h2"]).where("low < id").groupBy("id", "row").agg(F.collect_list("start").alias("starts"))
    ends = materialise(ends, "op1-ends")
    drop(parts, lows)
    marks = materialise(spots.where("size(pos) > 0").select("id", "row", "pos").join(ends, ["id", "row"], "full"), "op1-marks")
    drop(spots, ends)
    return rows.join(marks, ["id", "row"], "left").select("id", "text", "pos", "starts").mapInArrow(
        lambda it: _removed(it, length, k),
        f"id {id_type}, kept_text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>",
    )
