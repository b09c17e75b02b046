"""Benchmark decontamination by template canonicalisation.

Texts become tokens: runs of ASCII letters, digits and non-ASCII bytes, lower-cased.  Tokens with a digit
(``3``, ``1,000``, ``2.5``) become numbers, a unit word after a number becomes a unit, and a capitalised
word inside a sentence becomes a name.  A window is ``length`` consecutive tokens with typed placeholders in
place of those; at least half of its tokens must be literal.  A benchmark item of fewer tokens (but ``least``)
is one window.  Each window is also taken with names left literal, so a passage set in capitals still meets
its source, and without any placeholder, however many slots it has: a verbatim copy is always found.

Windows of benchmark and documents are joined on 128-bit hashes of their templates.  Slots must agree: equal
fillers in one must be equal in the other, and different ones different.  Windows of a document that match one item
in one alignment form a run, and this is asked of all fillers of a run.  A question whose numbers or names were
replaced throughout is thus caught; where fillers contradict each other, the windows that hold one of them do not
count.  Literal copies always do, whatever else stands in their run.  Benchmark windows without slots are kept once, from the smallest item.  Windows of one
template with slots are kept once for each pattern of their own fillers (places of first occurrence, ``0,1,0``)
and each form of item (template and pattern of the whole item), from the smallest: items of one form accept the same
documents, items of other forms each have runs of their own.

Before the join, documents are sieved by a bit map of benchmark hashes, the only thing broadcast: 16 bits a window, 16 MB
at most (``SIEVE_BITS``); false hits only cost rows.  A benchmark window in a third of all documents gives one row per
document, matched with one benchmark row (items of equal windows are aggregated first).

Edge cases: null or empty texts and items match nothing; items under ``least`` tokens are not searched; a null id
is not reported; ties between items go to the smallest item id; repeated rows count once; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise
from .textkernel import U64, batches, lower_case, mix64, odd_constants, signed, words

LENGTH, LEAST = 13, 6
SIEVE_BITS = 16, 27  # least and most: 8 KB to 16 MB

# Unit words.
UNITS = """km m cm mm kilometers meters metres miles mile feet foot inches inch yards kg g mg kilograms grams tons tonnes pounds
ounces l ml liters litres gallons s ms seconds second minutes minute hours hour days day weeks week months month years year
dollars dollar euros euro cents cent percent degrees degree mph kph watts volts joules bytes kb mb gb""".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"|"]] = True
_NUMBER, _UNIT, _NAME = 1, 2, 3
_NONE = np.zeros(0, U64)
_MARK = mix64(np.array([0, 101, 102, 103], U64))


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    return np.unique(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True).hash)


_UNIT_HASH = _unit_hashes()
_UNIT_SEEN = np.zeros(1 << 16, bool)
_UNIT_SEEN[(_UNIT_HASH >> U64(48)).astype(np.int64)] = True


class Typed:
    """Tokens of some documents with literal hash and slot type."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        raw = data[offs[0] : offs[-1]]
        offs = offs - offs[0]
        n = len(raw)
        digit = _DIGIT[raw]
        inside = np.zeros(n, bool)
        if n > 2:
            inside[1:-1] = ((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
        text = np.where(_LETTER[raw] | inside, lower_case(raw), np.uint8(0x20))
        w = words(text, offs)
        self.first, self.hash = w.first, w.hash
        kind = np.zeros(len(w.hash), np.int8)
        if len(w.hash):
            many = np.r_[0, np.cumsum(digit)]
            kind[many[w.end] > many[w.start]] = _NUMBER
            at = np.flatnonzero(_UNIT_SEEN[(w.hash >> U64(48)).astype(np.int64)])
            at = at[np.isin(w.hash[at], _UNIT_HASH)]
            begins = np.zeros(len(w.hash) + 1, bool)
            begins[w.first] = True
            at = at[(at > 0) & ~begins[at]]
            kind[at[kind[at - 1] == _NUMBER]] = _UNIT
            stops = np.r_[0, np.cumsum(_STOP[raw])]
            second = np.minimum(w.start + 1, n - 1)
            name = _UPPER[raw[w.start]] & (w.end - w.start > 1) & _LOWER[raw[second]] & ~begins[:-1] & (kind == 0)
            name[1:] &= stops[w.start[1:]] == stops[w.end[:-1]]
            kind[name] = _NAME
        self.kind = kind

    def templates(self, mode: int) -> tuple[np.ndarray, np.ndarray]:
        """Template hash of every token, and where it is a slot (mode 0), names literal (1), all literal (2)."""
        slot = (self.kind > 0) & (mode < 2) & ((self.kind != _NAME) | (mode < 1))
        return np.where(slot, _MARK[self.kind], self.hash), slot


def _grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    c = odd_constants(k, seed)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * c[0]
    for j in range(1, k):
        out += h[j : j + n] * c[j]
    return mix64(out + U64(k))


def pattern(fillers: np.ndarray) -> str:
    """Places of first occurrence of the fillers of a window, as text."""
    seen: dict[int, int] = {}
    return ",".join(str(seen.setdefault(int(x), len(seen))) for x in fillers)


def _form(t: Typed, doc: int, h: np.ndarray, slot: np.ndarray) -> bytes:
    """Digest of the template of a whole text and of the places where its fillers occur first."""
    part = slice(t.first[doc], t.first[doc + 1])
    _, place, back = np.unique(t.hash[part][slot[part]], return_index=True, return_inverse=True)
    return hashlib.blake2b(h[part].tobytes() + place[back].astype(np.int64).tobytes(), digest_size=16).digest()


def _found(t: Typed, k: int, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[str], list[list[int]]]]:
    """Mode, token place, two hashes, pattern and fillers of the windows of ``k`` tokens that ``keep`` lets through."""
    n = len(t.hash) - k + 1
    if n <= 0:
        return
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    inside = doc[:n] == doc[k - 1 :]
    before = np.full(n, k + 1)
    for mode in range(3):
        h, slot = t.templates(mode)
        many = np.r_[0, np.cumsum(slot)]
        slots = many[k:] - many[:n]
        new = inside & (slots < before)  # others have the template of the mode before
        before = slots
        if not new.any():
            continue
        one = _grams(h, k, 41)
        at = np.flatnonzero(new & (2 * slots <= k) & keep(one))
        if len(at):
            c = odd_constants(k, 42)
            two = mix64(sum((h[at + j] * c[j] for j in range(k)), np.zeros(len(at), U64)))
            fill = [t.hash[i : i + k][slot[i : i + k]] if many[i + k] > many[i] else _NONE for i in at]
            yield mode, at, one[at], two, [pattern(f) if len(f) else "" for f in fill], [signed(f).tolist() for f in fill]


def _bench(it: Iterator[pa.RecordBatch], length: int, least: int) -> Iterator[pa.RecordBatch]:
    everything = lambda x: np.ones(len(x), bool)
    for batch, data, offs in batches(it):
        t = Typed(data, offs)
        size = np.diff(t.first)
        doc = np.repeat(np.arange(batch.num_rows), size)
        for k in sorted({length} | set(size[(size >= least) & (size < length)].tolist())):
            for mode, at, one, two, shape, fill in _found(t, k, everything):
                use = np.flatnonzero(size[doc[at]] == k) if k < length else np.arange(len(at))
                item = doc[at[use]]
                made = t.templates(mode)
                form = {d: _form(t, d, *made) for d in {int(doc[at[i]]) for i in use if fill[i]}}
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(item)), pa.array((at[use] - t.first[item]).astype(np.int32)), pa.array(np.full(len(use), k, np.int32)), pa.array(signed(one[use])), pa.array(signed(two[use])),
                        pa.array([shape[i] for i in use], pa.string()), pa.array([form[int(doc[at[i]])] if fill[i] else b"" for i in use], pa.binary()), pa.array([fill[i] for i in use], pa.list_(pa.int64())),
                    ],
                    ["item", "at", "k", "one", "two", "shape", "form", "fill"],
                )


def _search(it: Iterator[pa.RecordBatch], sieve) -> Iterator[pa.RecordBatch]:
    lengths, packed = sieve.value
    bits = np.frombuffer(packed, np.uint8)
    mask = U64(8 * len(bits) - 1)

    def keep(x: np.ndarray) -> np.ndarray:
        at = x & mask
        return (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) > 0

    for batch, data, offs in batches(it):
        if offs[-1] == offs[0]:
            continue
        t = Typed(data, offs)
        for k in lengths:
            for _, at, one, two, _, fill in _found(t, k, keep):
                doc = np.searchsorted(t.first, at, side="right") - 1
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(doc)), pa.array((at - t.first[doc]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(signed(one)), pa.array(signed(two)),
                        pa.array(fill, pa.list_(pa.int64())),
                    ],
                    ["id", "at", "k", "one", "two", "fill"],
                )


def _sieve_bits(it: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sieve places of a task's windows as a bit map, sent as its bytes that are not zero."""
    own = np.zeros(bits // 8, np.uint8)
    for batch in it:
        at = np.asarray(batch.column(0)).view(U64) & U64(bits - 1)
        np.bitwise_or.at(own, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))
    hit = np.flatnonzero(own)
    yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(own[hit].astype(np.int32))], ["place", "bits"])


def _agreeing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the windows of each run none of whose pairs of fillers another pair of the run contradicts."""
    for batch in it:
        row, places = [], []
        for r in range(batch.num_rows):
            windows = batch.column(2)[r].as_py()
            pairs = {p for w in windows for p in zip(w["item_fill"], w["fill"], strict=True)}
            left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
            kept = {w["at"] for w in windows if all(left[a] == 1 and right[b] == 1 for a, b in zip(w["item_fill"], w["fill"], strict=True))}
            row += [r] * len(kept)
            places += kept
        at = pa.array(row, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32())], ["id", "item", "at"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """One row per document with matching windows: id, item (smallest), n_windows (distinct places), first_token."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    item_type, id_type = items.schema["item"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    bench = items.mapInArrow(lambda it: _bench(it, length, least), f"item {item_type}, at int, k int, one long, two long, shape string, form binary, fill array<long>")
    bench = bench.groupBy("k", "one", "two", "shape", "form").agg(F.min(F.struct("item", "at", "fill")).alias("b"))
    bench = materialise(bench.select("k", "one", "two", "shape", "b.item", F.col("b.at").alias("item_at"), F.col("b.fill").alias("item_fill")), "op9-benchmark")
    size = 1 << min(max(int(16 * bench.count()).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])  # 16 bits a window or more, while that is within bounds
    places = bench.select("one").mapInArrow(lambda it: _sieve_bits(it, size), "place int, bits int").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    got = places.toPandas()  # at most 2 ** SIEVE_BITS[1] / 8 rows, however large the benchmark
    bits = np.zeros(size // 8, np.uint8)
    bits[got["place"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    lengths = sorted(r["k"] for r in bench.select("k").distinct().collect())  # at most ``length`` values
    sent = spark.sparkContext.broadcast((lengths, bits.tobytes()))
    hits = rows.mapInArrow(lambda it: _search(it, sent), f"id {id_type}, at int, k int, one long, two long, fill array<long>")
    match = hits.join(bench, ["k", "one", "two"]).withColumn("run", F.col("at") - F.col("item_at"))
    windows = F.collect_set(F.struct("at", "item_fill", "fill"))  # of one alignment: at most as many as the item has, in each mode
    runs = match.groupBy("id", "item", "run").agg(windows.alias("windows"))
    counted = runs.select("id", "item", "windows").mapInArrow(_agreeing, f"id {id_type}, item {item_type}, at int")
    return counted.groupBy("id").agg(F.min("item").alias("item"), F.countDistinct("at").alias("n_windows"), F.min("at").alias("first_token"))
