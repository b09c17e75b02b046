"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Texts are compared after deleting every character of ``[\\x20\\x09-\\x0D]``.  The normalised bytes are cut
into blocks of a fixed size, blocks are sorted into integer names, then adjacent pairs of names are
named again, level by level, until one integer is left.  Equal names mean equal content at every
level, so (number of blocks, last name) is an identity without collisions.

Naming sorts the distinct blocks by (64-bit hash, content) and numbers them in that order.  A block
whose hash no other block has differs from all others already, so its content need not travel: only
repeated hashes bring their bytes to the sort, and those are compared in full.

Documents keep one row each throughout; equal blocks, pairs and identities meet in partial
aggregates, so a block of a third of all documents is one row per task there, and the joins back to
documents run between plain tables, which adaptive execution can split.

Edge cases: null counts as empty, and all empty texts are one group; ties of length go to the
smallest id, and a null id is the last choice; rows that share the kept id are all marked kept; rows
of equal id and text are counted each; rows of one id, or without one, are told apart by a 64-bit hash of
their text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialise

BLOCK = 4096
SENT_HASHES = 250_000  # of repeated blocks, sent to all tasks as 8 bytes each
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def _key(id_col: str) -> Column:
    """The id as text, null told apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null")).alias("key")


def squeezed(text: Column) -> Column:
    """``text`` without ASCII white space."""
    for c in _BLANK:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _numbered(keys: DataFrame, ranges: list[str], cols: list[str], label: str) -> DataFrame:
    """Distinct ``keys`` with integer names in sorted order; ranges are cut by integer columns whose values few rows share."""
    return materialise(keys.repartitionByRange(*ranges).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()), label)


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.char_length(text).alias("chars"), squeezed(text).cast("binary").alias("body"))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block).cast("int"))
    cut = lambda i: F.substring(F.col("body"), i * block + 1, F.lit(block))
    base = rows.withColumn("m", blocks)
    slim = base.select("id", "row", "chars", "m", F.sha2("body", 256).alias("sha"), F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.xxhash64(cut(i))).alias("hashes"))
    slim = materialise(slim, "op4-base")

    one = slim.select(_key("id"), "row", "m", "hashes").dropDuplicates(["key", "row"])
    parts = one.select("key", "row", "m", F.posexplode("hashes").alias("i", "hash"))
    counts = materialise(parts.groupBy("hash").agg(F.count("*").alias("n")), "op4-counts")
    again = counts.where("n > 1").select("hash")
    if again.limit(SENT_HASHES + 1).count() <= SENT_HASHES:
        again = F.broadcast(again)  # then texts stay where they are; more hashes meet them by a shuffle
    pieces = base.select(_key("id"), "row", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.struct(i.alias("i"), cut(i).alias("block")))).alias("b"))
    shared = pieces.select("key", "row", "b.i", F.xxhash64("b.block").alias("hash"), "b.block").join(again, "hash", "left_semi")
    shared = materialise(shared, "op4-shared")
    keys = counts.where("n = 1").select("hash", F.lit(None).cast("binary").alias("block")).union(shared.select("hash", "block").distinct())
    names = _numbered(keys, ["hash"], ["hash", "block"], "op4-names")
    alone = parts.join(names.where("block is null").select("hash", "name"), "hash").select("key", "row", "m", "i", "name")
    met = shared.join(names.where("block is not null"), ["hash", "block"]).select("key", "row", "i", "name").dropDuplicates(["key", "row", "i"])
    met = met.join(one.select("key", "row", "m"), ["key", "row"]).select("key", "row", "m", "i", "name")
    level = materialise(alone.union(met), "op4-level")
    drop(counts, shared, names)

    roots, step = [level.where("m = 1").select("key", "row", "m", "name")], 1
    most = slim.agg(F.max("m")).first()[0] or 1
    while step < most:
        step *= 2
        left, right = F.max(F.when(F.col("i") % 2 == 0, F.col("name"))), F.max(F.when(F.col("i") % 2 == 1, F.col("name")))
        pairs = level.where(F.col("m") > step // 2).groupBy("key", "row", "m", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        pairs = materialise(pairs, "op4-pairs")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "op4-pair-names")
        level = materialise(pairs.join(names, ["a", "b"]).select("key", "row", "m", "i", "name"), "op4-level")
        drop(pairs, names)
        roots.append(level.where(F.col("m") <= step).select("key", "row", "m", "name"))
    found = roots[0]
    for r in roots[1:]:
        found = found.union(r)

    named = slim.select("id", "row", "chars", "sha", _key("id")).join(found, ["key", "row"])
    named = materialise(named.select("id", "chars", "sha", "m", "name"), "op4-named")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("unknown"), F.col("id").alias("id")))
    groups = materialise(named.groupBy("m", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "op4-groups")
    return named.join(groups, ["m", "name"]).select(
        "id", F.col("best.id").alias("keep_id"), "group_size", F.col("id").eqNullSafe(F.col("best.id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
