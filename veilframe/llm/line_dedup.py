"""Line deduplication by distinct-site spread.

A line (without ASCII white space at its ends) that occurs on ``min_sites`` sites or more is boilerplate: it stays in
the smallest id that has it and goes from all other documents.  So a text whose lines are all widespread, such as
the copies of one popular page, survives once.  Lines of fewer than ``min_words`` words never count.

1. Lines become 128-bit hashes; a line seen fewer than ``min_sites`` times, or on one site only, is out.
2. For the rest a HyperLogLog sketch of the sites per line hash; sketches merge by aggregation, so a line of
   a third of all documents costs one sketch a task.
3. Lines whose estimate is near the threshold get exact distinct counts.  The band spans five standard errors
   of the sketch, at least one site, so the decision equals the exact one.
4. Line places to remove are gathered per document and the texts rebuilt; the removal list of a document
   is never longer than the document.

Edge cases: a null or empty text has no lines to remove (null stays null); blank lines stay; a null site counts
for no site; documents with a null id take part as occurrences but keep their lines; rows of one id and text are
treated alike; other columns are kept by ``remove_lines`` under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, fresh, materialise

MIN_SITES, MIN_WORDS = 10, 3
LOG_K = 12  # registers of a sketch: 2**LOG_K, standard error about 1.04 / 2**(LOG_K / 2)
_BLANK = " \t\n\x0b\f\r"


def _near(min_sites: int) -> float:
    return max(1.0, 5 * 1.04 / 2 ** (LOG_K / 2) * min_sites)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    line = F.btrim(F.col("part"), F.lit(_BLANK))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("at", "part"))
    rows = rows.select("id", "row", "site", "at", line.alias("line")).where(F.col("line").rlike(r"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){" + str(min_words - 1) + r"}[^\x20\x09-\x0D]") if min_words > 1 else F.col("line") != "")
    return rows.select("id", "row", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes on ``min_sites`` sites or more: h1, h2, first (smallest id)."""
    seen = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"), F.min("id").alias("first"))
    often = seen.where((F.col("n") >= min_sites) & (F.lit(min_sites <= 1) | (F.col("a") < F.col("b")))).select("h1", "h2", "first")
    often = materialise(often, "op10-often")
    spread = lines.select("h1", "h2", "site").join(often.select("h1", "h2"), ["h1", "h2"], "left_semi")
    sketch = spread.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    sketch = materialise(sketch, "op10-sketches")
    close = F.abs(F.col("sites") - min_sites) <= _near(min_sites)
    exact = spread.join(sketch.where(close).select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("site").alias("sites"))
    wide = sketch.where(~close).select("h1", "h2", "sites").union(exact).where(F.col("sites") >= min_sites)
    out = materialise(often.join(wide.select("h1", "h2"), ["h1", "h2"]), "op10-wide")
    drop(often, sketch)
    return out


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Places of boilerplate lines: id, row (xxhash64 of the text), gone (line numbers from 0)."""
    lines = materialise(_lines(docs, id_col, text_col, site_col, min_words), "op10-lines")
    wide = widespread(lines, min_sites)
    gone = lines.join(wide, ["h1", "h2"]).where("id <> first").groupBy("id", "row").agg(F.collect_set("at").alias("gone"))
    gone = materialise(gone, "op10-gone")
    drop(lines, wide)
    return gone.hint("merge")  # one plan at every size: a list that happens to be small is not broadcast


def without_lines(text: Column, gone: Column) -> Column:
    """``text`` without the lines numbered in ``gone`` (null: unchanged)."""
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    return F.when(gone.isNull() | text.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; all columns and rows stay, in their order and names.

    Its count of lines removed is in ``removals``.
    """
    i, row, lines = (fresh(x, docs.columns) for x in ("id", "row", "gone"))
    gone = removals(docs, id_col, text_col, site_col, min_sites, min_words).select(F.col("id").alias(i), F.col("row").alias(row), F.col("gone").alias(lines))
    joined = docs.join(gone, (docs[id_col] == F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(row)), "left")
    return joined.select(*[without_lines(docs[c].cast("string"), F.col(lines)).alias(c) if c == text_col else docs[c] for c in docs.columns])
