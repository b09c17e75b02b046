"""The scorer's operators in relational form, for checks at small dimensions and for use on tables of vectors.

Rows are (pos, vector) or long (pos, i, x); matrix products are joins with sums, the attention band is a range join
by buckets, dispatch is a grouping by expert.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import swiglu


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gather(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Embedding lookup: rows (pos, id) with the vector of ``table`` (id, vec)."""
    return ids.join(table, "id").select("pos", "id", "vec")


def project(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Matrix product: (pos, o, y) from rows (pos, vec) and weights (o, i, w), joined on the inner index.

    A weight table has the model's size, not the data's, so it is broadcast; sums are combined before the shuffle.
    """
    entries = rows.select("pos", F.posexplode("vec").alias("i", "x"))
    return entries.join(F.broadcast(weights), "i").groupBy("pos", "o").agg(F.sum(F.col("x") * F.col("w")).alias("y"))


def band_pairs(rows: DataFrame, band: int) -> DataFrame:
    """Pairs (pos, j) with |pos - j| <= band as an equi-join on buckets of ``band`` positions.

    ``rows`` is (pos, q, k, v); a position meets at most three buckets, so the result has 2 * band + 1 rows each.
    """
    left = rows.select("pos", "q", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("pos") / band) + d)).alias("bucket"))
    right = rows.select(F.col("pos").alias("j"), "k", "v", F.floor(F.col("pos") / band).alias("bucket"))
    return left.join(right, "bucket").where(F.abs(F.col("pos") - F.col("j")) <= band).drop("bucket")


def band_attention(rows: DataFrame, band: int, scale: float, sink: float) -> DataFrame:
    """(pos, i, y): softmax-weighted sum of values inside the band; the sink adds to the denominator only."""
    scored = band_pairs(rows, band).select("pos", "v", (dot(F.col("q"), F.col("k")) * scale).alias("s"))
    top = scored.groupBy("pos").agg(F.greatest(F.max("s"), F.lit(sink)).alias("m"))
    weighted = scored.join(top, "pos").select("pos", "m", "v", F.exp(F.col("s") - F.col("m")).alias("e"))
    total = weighted.groupBy("pos").agg((F.sum("e") + F.exp(F.lit(sink) - F.first("m"))).alias("den"))
    mixed = weighted.select("pos", "e", F.posexplode("v").alias("i", "x")).groupBy("pos", "i").agg(F.sum(F.col("e") * F.col("x")).alias("num"))
    return mixed.join(total, "pos").select("pos", "i", (F.col("num") / F.col("den")).alias("y"))


def rope_angles(pos: Column, head: int) -> tuple[Column, Column]:
    """Cosines and sines (arrays of head / 2) at a position, with blended frequencies."""
    from .transformer import FACTOR, FAST, ORIGINAL, SLOW, THETA

    half = head // 2
    low, high = (half * math.log(ORIGINAL / (t * 2 * math.pi)) / math.log(THETA) for t in (FAST, SLOW))
    gain = 0.1 * math.log(FACTOR) + 1.0
    rates = []
    for i in range(half):
        plain = THETA ** (-2.0 * i / head)
        blend = min(max((i - low) / (high - low), 0.0), 1.0)
        rates.append(plain * (1 - blend) + plain / FACTOR * blend)
    table = F.array(*[F.lit(r) for r in rates])
    return F.transform(table, lambda r: F.cos(pos * r) * gain), F.transform(table, lambda r: F.sin(pos * r) * gain)


def dispatch(routed: DataFrame, chunk: int = 16) -> DataFrame:
    """(expert, tokens, chunks, weight): work of each expert from rows (pos, expert, gate)."""
    return routed.groupBy("expert").agg(F.count("*").alias("tokens"), F.ceil(F.count("*") / chunk).cast("long").alias("chunks"), F.sum("gate").alias("weight"))


def experts(routed: DataFrame, weights: DataFrame) -> DataFrame:
    """(pos, slot, i, y): gated outputs of the chosen experts, from rows (pos, slot, expert, gate, vec).

    ``weights`` has one row an expert (expert, w1, b1, w2, b2) with one array of inputs per output; the first half of the
    hidden outputs is the gate of the activation.  Both products run in the row, so nothing but the join moves; adaptive
    execution sends the weights where they are small and splits a favoured expert.
    """
    hidden = F.transform("w1", lambda row, o: dot(row, F.col("vec")) + F.get("b1", o))
    rows = routed.join(weights, "expert").withColumn("act", swiglu(hidden))
    out = F.transform("w2", lambda row, o: (dot(row, F.col("act")) + F.get("b2", o)) * F.col("gate"))
    return rows.select("pos", "slot", F.posexplode(out).alias("i", "y"))


def reduce_slots(parts: DataFrame) -> DataFrame:
    """(pos, i, y): sum of the slots' outputs (pos, slot, i, y)."""
    return parts.groupBy("pos", "i").agg(F.sum("y").alias("y"))


def label_islands(labels: DataFrame) -> DataFrame:
    """(doc, category, first, last): runs of labels (doc, pos, label) by the previous label only."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("pos")
    cat, tag = F.floor((F.col("label") - 1) / 4), F.pmod(F.col("label") - 1, F.lit(4))
    rows = labels.select("doc", "pos", F.when(F.col("label") > 0, cat).alias("cat"), F.when(F.col("label") > 0, tag).alias("tag"))
    goes_on = (F.lag("tag").over(w) <= 1) & F.lag("cat").over(w).eqNullSafe(F.col("cat"))
    rows = rows.withColumn("opens", F.col("cat").isNotNull() & (F.col("tag").isin(0, 3) | ~F.coalesce(goes_on, F.lit(False))))
    rows = rows.withColumn("run", F.sum(F.col("opens").cast("int")).over(w))
    return rows.where("cat is not null").groupBy("doc", "run").agg(F.first("cat").cast("int").alias("category"), F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")
