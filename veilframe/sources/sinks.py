"""Results as text lines, JSON lines, token and log-probability dumps, and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, column: str) -> None:
    """One value per record, each ended by a line feed (a value may hold line feeds of its own)."""
    df.select(F.coalesce(F.col(column), F.lit(""))).write.text(path)


def token_dump(tokens: DataFrame) -> DataFrame:
    """doc_id, pos, id: one row per token."""
    return tokens.select("doc_id", F.posexplode("toks").alias("pos", "t")).select("doc_id", "pos", F.col("t.id").alias("id"))


def six_decimals(x: Column) -> Column:
    """A number as C prints it by ``%.6f``: its exact binary value rounded, ties to even (``format_string`` rounds them up)."""
    endless = F.when(F.isnan(x), "nan").when(x > 0, "inf").otherwise("-inf")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), endless).otherwise(F.call_function("format_number", x, F.lit("0.000000")))


def logprob_dump(scored: DataFrame) -> DataFrame:
    """doc_id, t, line: log probabilities of each token with six decimals, after its number and id where ``ids`` are given."""
    numbers = F.transform("v", six_decimals)
    if "ids" not in scored.columns:
        return scored.select("doc_id", F.posexplode("lp").alias("t", "v")).select("doc_id", "t", F.array_join(numbers, " ").alias("line"))
    rows = scored.select("doc_id", F.posexplode(F.arrays_zip("ids", "lp")).alias("t", "x")).select("doc_id", "t", F.col("x.ids").alias("id"), F.col("x.lp").alias("v"))
    return rows.select("doc_id", "t", F.concat(F.col("t").cast("string"), F.lit(" "), F.col("id").cast("string"), F.lit(" "), F.array_join(numbers, " ")).alias("line"))


def observed(tokens: DataFrame, name: str = "stats") -> tuple[DataFrame, Observation]:
    """``tokens`` (doc_id, toks) with counts of documents and tokens taken while it runs."""
    seen = Observation(name)
    return tokens.observe(seen, F.count("*").alias("docs"), F.sum(F.size("toks")).alias("tokens")), seen
