"""Windows of documents and batches of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(n_tokens: Column, n_ctx: int) -> Column:
    """Consecutive windows of at most ``n_ctx`` tokens: array of (seg, off, len); empty for no tokens."""
    last = ((n_tokens - 1) / n_ctx).cast("int")
    one = lambda i: F.struct(i.alias("seg"), (i * n_ctx).alias("off"), F.least(F.lit(n_ctx), n_tokens - i * n_ctx).cast("int").alias("len"))
    return F.when(n_tokens > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<seg:int,off:int,len:int>>"))


def segments(tokens: DataFrame, n_ctx: int, n_col: str = "n_tokens") -> DataFrame:
    """One row per window: doc_id, seg, off, len."""
    return tokens.select("doc_id", F.inline(windows(F.col(n_col).cast("int"), n_ctx)))


def cut(sizes: np.ndarray, n_ctx: int) -> list[tuple[int, int, int]]:
    """Windows (document, first token, tokens) of documents with the given numbers of tokens."""
    return [(d, o, int(min(n_ctx, n - o))) for d, n in enumerate(sizes.tolist()) for o in range(0, n, n_ctx)]


def pack(lengths: list[int], budget: int) -> list[list[int]]:
    """Next-fit batches in the given order: a window that does not fit opens the next batch; none is split."""
    out: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if not out or n > room:
            out.append([])
            room = budget
        out[-1].append(i)
        room -= n
    return out


def pack_column(lengths: Column, budget: int) -> Column:
    """Batch number of each of an array of window lengths, next-fit in order."""
    zero = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("int").alias("room"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fresh = n > acc["room"]
        batch = F.when(fresh, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), (F.when(fresh, F.lit(budget)).otherwise(acc["room"]) - n).cast("int").alias("room"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])
