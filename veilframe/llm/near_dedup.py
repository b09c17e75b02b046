"""Near-duplicate detection with b-bit MinHash.

A document's set holds its distinct ``n``-word shingles, ASCII letters lower-cased; a shorter document
has its whole word sequence as one shingle.  Documents are linked when
``100 * |A and B| >= percent * |A or B|``; the result is the connected components.

1. One scan gives each document its set's size and a 128-bit identity, ``BANDS * ROWS`` MinHash minima
   folded into band keys, and the two low bits of every minimum packed into eight longs.
2. Documents with equal sets are one class; only its smallest id goes on.
3. Bands propose candidates.  In each bucket every member is paired with one center, chosen by hash (a
   star), so a bucket costs as many pairs as it has members.
4. The packed signatures estimate similarity by bit counts, corrected for the chance of 1/4 that
   low bits agree by accident.  Of what is within five deviations of the threshold, each document's
   NEAREST centers are confirmed on full sets; the links give components.
5. A bucket that still holds several components is open.  Members outside its largest component may
   still be linked to the rest of it.  Two sets over the threshold share one of their first few shingles
   in any common order; the order here is by how many open members a shingle's slot has, so shingles
   that a whole bucket shares come last and meet nobody.  Sizes, packed signatures and two bounds of the
   overlap that no true link fails (places of the common shingle, parities of the sets) are tested inside
   that join, so hardly any pair but links leaves it; full sets confirm.  Members that are already connected need no
   further pair, so a group of many near copies never expands into pairs and still loses no link that
   could join two components.

At the threshold of 0.8 a pair is missed by all bands with probability (1 - 0.8**6)**40 = 5e-6.

Edge cases: null or empty text has an empty set and is linked with nothing; a null id is never linked
and kept; rows with one id count as one document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import drop, materialise
from .textkernel import U64, batches, grams, mix64, odd_constants, signed, words

BANDS, ROWS, BITS, LONGS = 40, 6, 2, 8
DEVIATIONS = 5.0
#: A list of at most so many (id, row) keys is sent to all tasks; a longer one is joined by shuffle.
SENT_KEYS = 100_000
NEAREST = 3
#: Slots of shingle counts that order the shingles of open members: a table of fixed size, whatever the corpus.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Longs of a set's parities: 512 bits, of which two sets differ in at most as many as they have shingles not in common.
PARITIES = 8
PARITY = [f"p{i}" for i in range(PARITIES)]
SIG = [f"s{i}" for i in range(LONGS)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and where each document's begin."""
    w = words(data, offs, lower=True)
    counts = np.diff(w.first)
    g = grams(w.hash, n, 5)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    cut = np.r_[0, np.cumsum(sizes)]
    out = np.empty(int(cut[-1]), U64)
    for d in range(len(counts)):
        a, b = cut[d], cut[d + 1]
        if counts[d] >= n:
            out[a:b] = g[w.first[d] : w.first[d] + (b - a)]
            out[a:b].sort()
        elif b > a:
            short = w.hash[w.first[d] : w.first[d + 1]]
            out[a] = mix64(np.array([np.bitwise_xor.reduce(mix64(short * odd_constants(len(short), 9)))], U64) + U64(len(short)))[0]
    if not len(out):
        return out, cut
    fresh = np.r_[True, out[1:] != out[:-1]]
    fresh[cut[:-1][sizes > 0]] = True
    return out[fresh], np.r_[0, np.cumsum(fresh)][cut]


def _signatures(it: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    k = BANDS * ROWS
    times = (odd_constants(k, 21) >> U64(32)).astype(np.uint32) | np.uint32(1)
    plus = (odd_constants(k, 22) >> U64(32)).astype(np.uint32)
    fold = odd_constants(ROWS, 23)
    for batch, data, offs in batches(it):
        sets, cut = shingle_sets(data, offs, n)
        size = np.diff(cut)
        full = np.flatnonzero(size)
        keys = np.zeros((batch.num_rows, BANDS), np.int64)
        packed = np.zeros((batch.num_rows, LONGS), U64)
        one = np.zeros(batch.num_rows, U64)
        two = np.zeros(batch.num_rows, U64)
        if len(full):
            at = cut[:-1][full]
            one[full] = np.add.reduceat(mix64(sets + U64(0x51ED27)), at)
            two[full] = np.add.reduceat(mix64(sets ^ U64(0xA0761D6478BD642F)), at)
            x = (sets >> U64(32)).astype(np.uint32)
            low = np.empty((len(full), k), np.uint32)
            y = np.empty_like(x)
            for i in range(k):
                np.bitwise_xor(x, plus[i], out=y)
                np.multiply(y, times[i], out=y)
                low[:, i] = np.minimum.reduceat(y, at)
            wide = low.astype(U64).reshape(len(full), BANDS, ROWS)
            keys[full] = signed(mix64((wide * fold).sum(axis=2, dtype=U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)))
            bits = (low & np.uint32((1 << BITS) - 1)).astype(U64)
            for i in range(k):
                packed[full, i * BITS // 64] |= bits[:, i] << U64(i * BITS % 64)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), pa.array(signed(one)), pa.array(signed(two))]
            + [pa.array(signed(packed[:, i])) for i in range(LONGS)]
            + [pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))],
            ["id", "row", "n", "one", "two", *SIG, "keys"],
        )


def _sets(it: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in batches(it):
        sets, cut = shingle_sets(data, offs, n)
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(sets)))], ["id", "set"])


def differing(a: str, b: str) -> Column:
    """How many minima differ in their retained bits: xor, fold each pair of bits, count."""
    low = F.lit(0x5555555555555555)
    total = None
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        c = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
        total = c if total is None else total + c
    return total


def _allowed(percent: int) -> int:
    """Differing minima of a pair at the threshold, and DEVIATIONS standard deviations more."""
    k, r = BANDS * ROWS, 2.0**-BITS
    p = (1 - percent / 100) * (1 - r)  # a bit pair differs if the minima do and do not collide
    return int(k * p + DEVIATIONS * (k * p * (1 - p)) ** 0.5) + 1


def _sets_of(ids: DataFrame, reps: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Full shingle sets of the given ids, as a table (id, set)."""
    need = materialise(reps.select("id", "row").join(ids, "id", "left_semi"), "op3-need")
    if need.count() <= SENT_KEYS:
        need = F.broadcast(need)
    sets = texts.join(need, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]).select("id", "text").mapInArrow(lambda it: _sets(it, n), f"id {texts.schema['id'].dataType.simpleString()}, set array<bigint>")
    return materialise(sets, "op3-sets")


def _alike(a: str, b: str, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The links among candidate pairs (u, v), confirmed on full shingle sets."""
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), reps, texts, n)
    near = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    links = materialise(near.where(_alike("a", "b", percent)).select("u", "v"), "op3-links")
    drop(sets)
    return links


def _crowding(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle of each slot."""
    out = np.zeros(SLOTS, np.int64)
    for batch in it:
        out += np.bincount((np.asarray(batch.column(1).flatten()).view(U64) >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
    hit = np.flatnonzero(out)
    yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(out[hit])], ["slot", "n"])


def _leading(it: Iterator[pa.RecordBatch], crowd, percent: int) -> Iterator[pa.RecordBatch]:
    """The shingles of each set in the least crowded slots, so many that two sets over the threshold share one, and their places."""
    for batch in it:
        flat, offs = _flat(batch)
        size = np.diff(offs)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, crowd.value[(flat.view(U64) >> U64(64 - SLOT_BITS)).astype(np.int64)], doc))
        lead = size - (size * percent + 99) // 100 + 1
        place = np.arange(len(flat)) - offs[doc]
        use = np.flatnonzero(place < lead[doc])
        yield pa.record_batch([batch.column(0).take(pa.array(doc[use])), pa.array(flat[order[use]]), pa.array(place[use].astype(np.int32))], ["id", "g", "place"])


def _parities(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity of the number of shingles in each of 64 * PARITIES slots, packed."""
    for batch in it:
        flat, offs = _flat(batch)
        at = flat.view(U64) % U64(64 * PARITIES)
        out = np.zeros((batch.num_rows, PARITIES), U64)
        np.bitwise_xor.at(out, (np.repeat(np.arange(batch.num_rows), np.diff(offs)), (at >> U64(6)).astype(np.int64)), U64(1) << (at & U64(63)))
        yield pa.record_batch([batch.column(0), *[pa.array(signed(out[:, i])) for i in range(PARITIES)]], ["id", *PARITY])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all sets of a batch (id, set), and where each set begins."""
    sets = batch.column(1)
    offs = sets.offsets.to_numpy().astype(np.int64)
    return np.asarray(sets.flatten()), offs - offs[0]


def _possible(percent: int) -> Column:
    """No pair over the threshold fails this: what its common shingle's places and its parities leave for the overlap is enough."""
    both = F.col("x.n") + F.col("y.n")
    odd = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in PARITY), F.lit(0))  # at most as many as are in one set only
    ahead = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))  # holds for the first shingle that both have
    return ((both - odd) * (100 + percent) >= 2 * percent * both) & (ahead * (100 + percent) >= percent * both)


def _across(held: DataFrame, slim: DataFrame, reps: DataFrame, texts: DataFrame, n: int, percent: int, likely: Column) -> DataFrame | None:
    """Confirmed links between components that met in open buckets; ``held`` has their members (id, root, outside)."""
    if held.isEmpty():
        return None
    spark, id_type = held.sparkSession, held.schema["id"].dataType.simpleString()
    sets = _sets_of(held.select("id"), reps, texts, n)
    got = sets.mapInArrow(_crowding, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows, as columns: row objects would take hundreds of MB
    crowd = np.zeros(SLOTS, np.int64)
    crowd[got["slot"].to_numpy()] = got["n"].to_numpy()
    sent = spark.sparkContext.broadcast(crowd)
    lead = materialise(sets.mapInArrow(lambda it: _leading(it, sent, percent), f"id {id_type}, g long, place int").join(held, "id"), "op3-lead")
    met = lead.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("outside").alias("outside")).where("a < b and outside").select("g")
    met = materialise(met, "op3-met")
    parities = sets.mapInArrow(_parities, f"id {id_type}, " + ", ".join(f"{p} long" for p in PARITY))
    lead_met = materialise(lead.join(met, "g", "left_semi").join(slim, "id").join(parities, "id"), "op3-meeting")
    drop(met, lead)
    x, y = lead_met.where("outside").alias("x"), lead_met.alias("y")
    across = (F.col("x.g") == F.col("y.g")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.outside") | (F.col("x.id") < F.col("y.id"))) & likely & _possible(percent)
    pairs = materialise(x.join(y, across).select(F.col("x.id").alias("u"), F.col("y.id").alias("v")).distinct(), "op3-likely")
    drop(lead_met)
    near = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    extra = materialise(near.where(_alike("a", "b", percent)).select("u", "v"), "op3-extra")
    drop(pairs, sets)
    return None if extra.isEmpty() else extra


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component (smallest id reachable), kept."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    sig = ", ".join(f"{s} long" for s in SIG)
    base = materialise(texts.mapInArrow(lambda it: _signatures(it, n), f"id {id_type}, row long, n long, one long, two long, {sig}, keys array<bigint>"), "op3-base")
    full = base.where("n > 0 and id is not null")
    classes = materialise(full.groupBy("one", "two", "n").agg(F.min(F.struct("id", "row")).alias("rep")), "op3-classes")
    reps = full.join(classes.select("rep.id", "rep.row"), ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    reps = materialise(reps.select("id", "row", "n", *SIG, "keys"), "op3-reps")

    placed = reps.select("id", F.explode("keys").alias("key"))
    middle = F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id"))
    buckets = placed.groupBy("key").agg(middle.alias("c"), F.min("id").alias("low"), F.max("id").alias("high"))
    buckets = materialise(buckets.where("low < high").select("key", F.col("c.id").alias("center")), "op3-buckets")
    crowd = materialise(placed.join(buckets, "key"), "op3-crowd")
    drop(buckets)
    slim = reps.select("id", "n", *SIG)
    allowed = _allowed(percent)
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)

    stars = crowd.where("id <> center").select(F.col("id").alias("u"), F.col("center").alias("v")).distinct()
    stars = stars.join(slim.alias("x"), F.col("u") == F.col("x.id")).join(slim.alias("y"), F.col("v") == F.col("y.id"))
    stars = stars.where(sizes).select("u", "v", differing("x", "y").alias("apart")).where(F.col("apart") <= allowed)
    best = F.slice(F.array_sort(F.collect_list(F.struct("apart", "v"))), 1, NEAREST)  # at most one center a band
    stars = materialise(stars.groupBy("u").agg(best.alias("best")).select("u", F.explode("best.v").alias("v")), "op3-stars")
    links = _confirm(stars, reps, texts, n, percent)
    drop(stars)
    roots = materialise(components(links), "op3-roots")

    at = crowd.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    at = materialise(at, "op3-at")
    drop(crowd)
    share = at.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("parts"))
    share = materialise(share.where("parts > 1").select("key", "main"), "op3-share")
    held = at.join(share, "key").groupBy("id").agg(F.max("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("outside"))
    held = materialise(held, "op3-open")
    drop(at, share)
    extra = _across(held, slim, reps, texts, n, percent, sizes & (differing("x", "y") <= allowed))
    if extra is not None:
        roots = materialise(components(links.union(extra)), "op3-merged")
        drop(extra)
    drop(held, links)

    named = classes.select("one", "two", "n", F.col("rep.id").alias("node")).join(roots, "node", "left").select("one", "two", "n", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "op3-named")
    drop(reps, roots)
    out = base.where("n > 0").select("id", "n", "one", "two").join(named, ["one", "two", "n"]).select("id", "n", F.when(F.col("id").isNotNull(), F.col("root")).alias("component"))
    alone = base.where("n = 0").select("id", "n", F.col("id").alias("component"))
    lost = base.where("n > 0 and id is null").select("id", "n", "one", "two").join(classes, ["one", "two", "n"], "left_anti").select("id", "n", F.col("id").alias("component"))
    return out.union(alone).union(lost).select("id", F.col("n").alias("n_shingles"), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
