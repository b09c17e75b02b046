"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialise


def _star(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang each neighbour of ``u`` on the smallest node that ``u`` sees (itself included).

    The minima are a table of their own (returned too), so that the join can split a node of many neighbours.
    """
    low = materialise(near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")), "star-lows")
    return near.join(low, "u"), low


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Nothing is collected but a count and a checksum a round, the rounds grow with the logarithm of
    the longest chain, and every round is written to the shared folder.  Loops and repeated edges
    are allowed; an empty table gives an empty table.
    """
    both = edges.where("u <> v").select("u", "v")
    now = materialise(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        near = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, low = _star(near)
        large = materialise(star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        drop(low)
        grown, low = _star(large)
        small = grown.select(F.col("v").alias("u"), F.col("m").alias("v")).union(grown.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(small, "small-star")
        drop(now, large, low)
        now, before, seen = after, seen, _print(after)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
