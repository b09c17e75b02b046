"""Language-model scores from a Brown class bigram model.

The model: P(w | v) = P(class(w) | class(v)) * P(w | class(w)), over the words of a text and one end token; the end
token also stands before the first word.

Exchange clustering assigns a class to every word seen LEAST times in training, however large the vocabulary:

1. The CORE most frequent words, and the shapes (last letters and closing punctuation, GROUPS of them) that stand for
   all others, move one at a time to the class that raises the likelihood of the class bigrams most, until a round
   changes nothing (at most ROUNDS).  The driver holds at most (CORE + GROUPS + 1) ** 2 bigrams, whatever the corpus.
2. Sweeps over all words seen 1 / HEAD of all tokens (at most HEAD of them): the classes before and after each word are
   counted over all training texts, and each word goes where its own gain is largest, all others held; words move in
   Spark tasks, a class map of one byte a word comes back.  Sweeps end when the likelihood of the class
   bigrams rises by less than TOLERANCE of itself (at most SWEEPS).
3. Rarer words get the same step once, against the classes that the sweeps have reached.

Words seen less often, and unseen ones, take the class of their shape.  Class bigrams are counted again over all training
texts with the classes of all words.

Smoothing: class transitions are interpolated with class frequencies (weight KAPPA); a word with a class of its own, and a
shape, has ALPHA extra counts in its class; inside a shape, a word has one extra count and unknown words share one more
(add-one as in the base score).  All three are proper distributions.

Words are named by 64-bit hashes of their lower-cased bytes: in a vocabulary of a billion words some two of them share
one with probability 0.03, and then count as one.  Texts are cut into words twice, for the counts and to be coded; all later
passes read the codes.  Words that are not sent to the tasks cannot be hot (under 1 / HEAD of the tokens
each) and are looked up once, by a distributed join.

Edge cases: a null or empty text is one end token; with nothing to train on, every probability of the base
is 1 and the model falls back on uniform classes; repeated rows are scored each; a null id trains and
is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialise
from .textkernel import U64, batches, release, signed, string_buffers, words

CORE, GROUPS, CLASSES, HEAD = 1000, 509, 128, 1_000_000
KAPPA, ALPHA, ROUNDS = 50.0, 0.5, 10
LEAST, SWEEPS, TOLERANCE = 2, 4, 1e-3
PAIRS = 1 << 20  # keys that a task counts before it sends them on
RUN = 1 << 18  # tokens handled at a time
MARKS = 8  # closing marks looked through for a shape
_CLOSES = np.zeros(256, bool)
_CLOSES[[*b".,;:!?)\"'|"]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[0x41:0x5B] += 32


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Shape group of each word ``data[start:end]``: last three letters, and how it closes."""
    stem = end.copy()
    for _ in range(MARKS):
        stem -= (stem > start) & _CLOSES[data[np.maximum(stem - 1, 0)]]
    size, marks = stem - start, end - stem
    last = lambda j: _LOWER[data[np.maximum(stem - j, 0)]]
    h = np.where(size > 1, last(1) * 31 + last(2) * 7 + np.where(size > 2, last(3) * 3, 1), size)
    first = data[np.minimum(stem, len(data) - 1)] if len(data) else stem
    stops = (marks == 1) & ((first == 0x2E) | (first == 0x21) | (first == 0x3F))
    return (h * 5 + np.where(stops, 1, np.where(marks > 0, 2, 0))) % GROUPS


def shape(word: bytes) -> int:
    return int(shapes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


class Tally:
    """Counts of integer keys with a value each, merged when many have gathered."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((keys, n, value))
        self.size += len(keys)

    def rows(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What is to be sent on now, in bounded pieces: everything at the end, else what has grown too large."""
        if not self.parts or (self.size <= PAIRS and not last):
            return
        keys, n, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        n, value = np.bincount(back, n, len(keys)).astype(np.int64), value[at]
        self.parts, self.size = [(keys, n, value)], len(keys)
        if last or len(keys) > PAIRS // 2:
            for lo in range(0, len(keys), RUN):
                yield keys[lo : lo + RUN], n[lo : lo + RUN], value[lo : lo + RUN]
            self.parts, self.size = [], 0


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with shape and count; the row without a word counts the ends."""
    tally, ends = Tally(), 0

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        for keys, n, group in tally.rows(last):
            yield pa.record_batch([pa.array(keys), pa.array(group.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])

    for batch, data, offs in batches(it):
        w = words(data, offs, lower=True)
        ends += batch.num_rows
        keys, at, n = np.unique(signed(w.hash), return_index=True, return_counts=True)
        tally.add(keys, n, shapes(data, w.start[at], w.end[at]))
        yield from out(False)
    yield from out(True)
    if ends:
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.array([ends], pa.int64())], ["word", "shape", "n"])


def _code(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Texts as codes: 0 the end, 1 and more the words sent, below 0 the words to be looked up, numbered in their text."""
    head = sent.value
    uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    for batch, data, offs in batches(it):
        rows = batch.num_rows
        w = words(data, offs, lower=True)
        doc = w.document()
        key, back = np.unique(w.hash, return_inverse=True)
        place = np.minimum(np.searchsorted(head, key), max(len(head) - 1, 0))
        known = np.where(head[place] == key, place + 1, -1) if len(head) else np.full(len(key), -1)
        code = known[back].astype(np.int32)
        rest = np.flatnonzero(code < 0)
        order = rest[np.lexsort((w.hash[rest], doc[rest]))]
        h, d = w.hash[order], doc[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(order) else np.zeros(0, bool)
        number = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        cut = np.searchsorted(d[first], np.arange(rows + 1))
        code[order] = -1 - (number - cut[d])
        whole = np.zeros(len(code) + rows, np.int32)
        whole[np.arange(len(code)) + doc] = code
        ends = (w.first + np.arange(rows + 1)) * 4
        lists = pa.array(cut.astype(np.int32))
        new = order[first]
        yield pa.record_batch(
            [
                pa.array(uid + np.arange(rows)), batch.column(0), batch.column(2),
                pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(whole)]),
                pa.ListArray.from_arrays(lists, pa.array(signed(h[first]))), pa.ListArray.from_arrays(lists, pa.array(shapes(data, w.start[new], w.end[new]).astype(np.int32))),
            ],
            ["uid", "id", "train", "codes", "words", "shapes"],
        )
        uid += rows


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    return np.asarray(column.flatten()), column.offsets.to_numpy().astype(np.int64) - (column.offsets[0].as_py() if len(column) else 0)


class Coded(NamedTuple):
    """Coded texts: tokens ``first[d]:first[d+1]``, and the looked-up words of all of them, ``cut[d]:cut[d+1]``."""

    batch: pa.RecordBatch
    code: np.ndarray
    first: np.ndarray
    group: np.ndarray  # shape of each looked-up word
    cut: np.ndarray
    seek: np.ndarray  # tokens that are looked up
    word: np.ndarray  # and the looked-up word of each

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def kinds(self, sent: np.ndarray, of_words: np.ndarray) -> np.ndarray:
        """Class of each token from those of the codes that were sent and of the looked-up words."""
        out = sent[np.maximum(self.code, 0)]
        out[self.seek] = of_words[self.word]
        return out

    def before(self, kind: np.ndarray) -> np.ndarray:
        """What stands before each token; the end (0) before the first of a text."""
        out = np.empty_like(kind)
        out[1:] = kind[:-1]
        out[self.first[:-1]] = 0
        return out


def _coded(it: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    for whole in it:
        if not whole.num_rows:
            continue
        raw, offs = string_buffers(whole.column(whole.schema.get_field_index("codes")))
        lo = 0
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + 4 * RUN, side="right")) - 1)
            batch = whole.slice(lo, hi - lo)
            code = raw[offs[lo] : offs[hi]].view(np.int32)
            first = (offs[lo : hi + 1] - offs[lo]) // 4
            group, cut = _flat(batch.column(batch.schema.get_field_index("shapes")))
            seek = np.flatnonzero(code < 0)
            doc = np.searchsorted(first, seek, side="right") - 1
            yield Coded(batch, code, first, group, cut, seek, cut[doc] - 1 - code[seek])
            lo = hi
    release()


def _pairs(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Bigrams of core items."""
    item, base = sent.value  # item of each code; items of shapes begin at base
    m = base + GROUPS
    out, keys, held = np.zeros(m * m, np.int64), [], 0
    for c in _coded(it):
        kind = c.kinds(item, base + c.group)
        keys.append(c.before(kind) * m + kind)
        held += len(kind)
        if held > 4 * RUN:
            out += np.bincount(np.concatenate(keys), minlength=m * m)
            keys, held = [], 0
    if keys:
        out += np.bincount(np.concatenate(keys), minlength=m * m)
    hit = np.flatnonzero(out)
    for lo in range(0, len(hit), RUN):
        yield pa.record_batch([pa.array(hit[lo : lo + RUN]), pa.array(out[hit[lo : lo + RUN]])], ["pair", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Pairs:
    """Sparse bigram counts of items, by row and by column."""

    def __init__(self, first: np.ndarray, second: np.ndarray, n: np.ndarray, m: int) -> None:
        self.m, self.first, self.second, self.n = m, first, second, n.astype(float)
        self.by = []
        for a, b in ((first, second), (second, first)):
            order = np.argsort(a, kind="stable")
            self.by.append((np.searchsorted(a[order], np.arange(m + 1)), b[order], self.n[order]))

    def after(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Items that follow ``w``, with counts."""
        cut, other, n = self.by[0]
        return other[cut[w] : cut[w + 1]], n[cut[w] : cut[w + 1]]

    def before(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        cut, other, n = self.by[1]
        return other[cut[w] : cut[w + 1]], n[cut[w] : cut[w + 1]]

    def totals(self) -> np.ndarray:
        return np.bincount(self.second, self.n, self.m)

    def classes(self, of: np.ndarray, classes: int) -> np.ndarray:
        return np.bincount(of[self.first] * classes + of[self.second], self.n, classes * classes).reshape(classes, classes)


def exchange(pairs: Pairs, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item by the exchange algorithm; item 0 (the end) keeps class 0 to itself."""
    m = pairs.m
    order = 1 + np.argsort(-pairs.totals()[1:], kind="stable")
    of = np.zeros(m, np.int64)
    of[order] = 1 + np.arange(m - 1) % (classes - 1)
    table = pairs.classes(of, classes)
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in order:
            (follow, nf), (lead, nl), old = pairs.after(w), pairs.before(w), of[w]
            if not len(follow) and not len(lead):
                continue
            own = nf[follow == w].sum()
            r = np.bincount(of[follow], nf, classes)  # counts of the item before and after each class
            c = np.bincount(of[lead], nl, classes)
            table[old] -= r
            table[:, old] -= c
            table[old, old] += own
            r0, c0 = r.copy(), c.copy()
            r0[old] -= own
            c0[old] -= own  # neighbours other than the item itself
            rows = (_xlogx(table + r0) - _xlogx(table)).sum(axis=1)
            cols = (_xlogx(table + c0[:, None]) - _xlogx(table)).sum(axis=0)
            d = table[diagonal, diagonal]
            cross = _xlogx(d + r0 + c0 + own) - _xlogx(d + r0) - _xlogx(d + c0) + _xlogx(d)
            before, after = table.sum(axis=1) + c0, table.sum(axis=0) + r0  # totals with the neighbours' counts of w back
            gain = rows + cols + cross - (_xlogx(before + r.sum()) - _xlogx(before)) - (_xlogx(after + c.sum()) - _xlogx(after))
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += r0
            table[:, new] += c0
            table[new, new] += own
            moved += new != old
            of[w] = new
        if not moved:
            break
    return of


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to a constant of the words."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


_SIDES = 2 * CLASSES  # beside a word: classes before it, then classes after it


def _beside(c: Coded, kind: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys (word, side, class) of what stands beside the tokens ``at``."""
    prev = c.before(kind)[at]
    after = np.r_[kind[1:], 0][at]  # a word is never last: the end is
    return np.concatenate([word * _SIDES + prev, word * _SIDES + CLASSES + after])


def _contexts(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Class bigrams (keys below 0), and classes beside the words that were sent (word * _SIDES + side and class)."""
    kinds, of_shape, use = sent.value  # by code; words that can move
    tally, table = Tally(), np.zeros(CLASSES * CLASSES, np.int64)

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        for keys, n, _ in tally.rows(last):
            yield pa.record_batch([pa.array(keys), pa.array(n)], ["key", "n"])

    for c in _coded(it):
        kind = c.kinds(kinds, of_shape[c.group])
        table += np.bincount(c.before(kind) * CLASSES + kind, minlength=len(table))
        at = np.flatnonzero(use[np.maximum(c.code, 0)])
        keys, n = np.unique(_beside(c, kind, at, c.code[at].astype(np.int64)), return_counts=True)
        tally.add(keys, n, keys)
        yield from out(False)
    yield from out(True)
    yield pa.record_batch([pa.array(-1 - np.arange(len(table))), pa.array(table)], ["key", "n"])


def _rare_contexts(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Classes beside words that are looked up: word, side and class, count in a run of texts."""
    kinds, of_shape = sent.value
    for c in _coded(it):
        if not len(c.seek):
            continue
        kind = c.kinds(kinds, of_shape[c.group])
        hashes = _flat(c.column("words"))[0]
        key, n = np.unique(_beside(c, kind, c.seek, c.word), return_counts=True)
        yield pa.record_batch([pa.array(hashes[key // _SIDES]), pa.array((key % _SIDES).astype(np.int32)), pa.array(n)], ["word", "side", "n"])


def best_classes(row: np.ndarray, side: np.ndarray, n: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of each word that gains most, all other words held.

    ``row``, ``side``, ``n``: counts of classes before (0 to CLASSES - 1) and after (CLASSES on) each word; ``old``: the
    word's present class, -1 if the counts of ``table`` do not hold it.  Cells that both sides of a word touch are
    taken one side at a time.
    """
    m, classes = len(old), len(table)
    total = np.bincount(row[side < classes], n[side < classes], m)
    gain = np.zeros((m, classes))
    mine = old[row]
    for lead in (True, False):
        at = np.flatnonzero((side < classes) == lead)
        cls = side[at] % classes
        cells = table[cls] if lead else table[:, cls].T  # entry x destination
        own = cells[np.arange(len(at)), np.maximum(mine[at], 0)] - n[at]
        value = _xlogx(cells + n[at][:, None]) - _xlogx(cells)
        held = np.flatnonzero(mine[at] >= 0)
        low = np.maximum(own[held], 0)
        value[held, mine[at][held]] = _xlogx(low + n[at][held]) - _xlogx(low)
        order = np.argsort(row[at], kind="stable")
        at_rows = row[at][order]
        starts = np.flatnonzero(np.r_[True, at_rows[1:] != at_rows[:-1]]) if len(at_rows) else np.zeros(0, np.int64)
        if len(starts):
            gain[at_rows[starts]] += np.add.reduceat(value[order], starts, axis=0)
    for margin in (table.sum(axis=1), table.sum(axis=0)):
        cost = _xlogx(margin + total[:, None]) - _xlogx(margin)
        held = np.flatnonzero(old >= 0)
        low = np.maximum(margin[old[held]] - total[held], 0)
        cost[held, old[held]] = _xlogx(low + total[held]) - _xlogx(low)
        gain -= cost
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    stay = np.flatnonzero(old > 0)
    stay = stay[gain[stay, best[stay]] <= gain[stay, old[stay]] + 1e-9]
    best[stay] = old[stay]
    return best


def _move(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Best class of each word (name, sides, counts); ``kinds`` has the present ones by name, None: words not placed yet."""
    table, kinds = sent.value
    for whole in it:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)  # at most 256 * _SIDES entries of CLASSES values
            name = batch.column(0).to_numpy()
            side, cut = _flat(batch.column(1))
            n, _ = _flat(batch.column(2))
            old = np.full(len(name), -1) if kinds is None else kinds[name].astype(np.int64)
            best = best_classes(np.repeat(np.arange(len(name)), np.diff(cut)), side.astype(np.int64), n.astype(float), old, table)
            yield pa.record_batch([batch.column(0), pa.array(best.astype(np.int32))], ["name", "kind"])


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of the words that are sent
    counts: np.ndarray  # by code: the end, then these words
    kinds: np.ndarray  # class by code, that of the shape where it has none of its own
    groups: np.ndarray  # shape by code, -1 for a class of its own
    of_shape: np.ndarray  # class of each shape
    inside: np.ndarray  # of each shape, log10 P(shape | class) less log10 of the shape's mass
    total: np.ndarray  # log10 of each class's mass
    step: np.ndarray  # class x class, log10 P(next | previous)
    tokens: int  # N
    types: int  # V
    assigned: float  # share of N in words with a class of their own

    def emission(self, kind: np.ndarray, group: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | its class)."""
        return np.where(group < 0, np.log10(n + ALPHA) - self.total[kind], self.inside[group] + np.log10(n + 1.0))


def _fit(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows (id, text, train) that train, its table of rarer words (word, n, kind), and all rows resolved."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast
    counts = rows.where("train").select("text").mapInArrow(_count, "word long, shape int, n long")
    counts = materialise(counts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")), "op2-counts")
    tokens, types, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    words_only = counts.where("word is not null")
    head = words_only.where(F.col("n") >= tokens / HEAD).toArrow()  # at most HEAD words
    name, n, group = head["word"].to_numpy().view(U64), head["n"].to_numpy(), head["shape"].to_numpy().astype(np.int64)
    order = np.argsort(name)
    name, n, group = name[order], np.r_[ends, n[order]], np.r_[-1, group[order]]
    small = words_only.where(F.col("n") < LEAST).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # at most GROUPS rows
    weight, members = np.zeros(GROUPS), np.zeros(GROUPS)
    weight[small["shape"]], members[small["shape"]] = small["n"], small["kinds"]
    coded = _code_all(rows, name)
    texts = coded.where("train").select("codes", "words", "shapes")

    moves = n >= LEAST  # by code
    moves[0] = False
    top = np.flatnonzero(moves)
    top = top[np.lexsort((name[top - 1], -n[top]))][:CORE]
    base = 1 + len(top)
    item = np.r_[0, base + group[1:]]
    item[top] = np.arange(1, base)
    made = sent((item, base))
    bigrams = materialise(texts.mapInArrow(lambda it: _pairs(it, made), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "op2-bigrams")
    seen = bigrams.toArrow()  # at most (CORE + GROUPS + 1) ** 2 rows
    drop(bigrams)
    m = base + GROUPS
    key = seen["pair"].to_numpy()
    of = exchange(Pairs(key // m, key % m, seen["n"].to_numpy(), m))
    of_shape = of[base:]
    kinds = of[item]

    kinds, table = _sweep(texts, kinds, of_shape, moves)
    group = np.where(moves | (np.arange(len(n)) == 0), -1, group)
    rare = _placed(texts, words_only.where(F.col("n") < tokens / HEAD).select("word", "n"), kinds, of_shape, table)
    drop(counts)
    mass, used = np.bincount(kinds[group < 0], n[group < 0], CLASSES), np.bincount(kinds[group < 0], minlength=CLASSES).astype(float)
    own = float(n[moves].sum())
    for r in rare.where("kind >= 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # at most CLASSES rows
        mass[r["kind"]] += r["n"]
        used[r["kind"]] += r["kinds"]
        own += r["n"]
    mass += np.bincount(of_shape, weight, CLASSES)
    used += np.bincount(of_shape, minlength=CLASSES)
    with np.errstate(divide="ignore"):
        total = np.log10(mass + ALPHA * used)
    inside = np.log10(weight + ALPHA) - total[of_shape] - np.log10(weight + members + 1)

    resolved = _resolved(coded, rare)
    drop(coded)
    last = sent((kinds, of_shape))
    steps = resolved.where("train").mapInArrow(lambda it: _steps(it, last), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most CLASSES ** 2 rows
    trans = np.bincount(steps["pair"].to_numpy(np.int64), steps["n"].to_numpy(float), CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    plain = np.where(used > 0, mass + 1, 0)
    with np.errstate(divide="ignore"):
        step = np.log10((trans + KAPPA * plain / plain.sum()) / (trans.sum(axis=1, keepdims=True) + KAPPA))
    return Model(name, n, kinds, group, of_shape, inside, total, step, int(tokens), int(types), own / max(tokens, 1)), rare, resolved


def _sweep(texts: DataFrame, kinds: np.ndarray, of_shape: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words that were sent after sweeps of moves, and their class bigrams."""
    sent = texts.sparkSession.sparkContext.broadcast
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for last in [False] * SWEEPS + [True]:
        known = sent((kinds, of_shape, np.zeros_like(moves) if last else moves))
        sums = texts.mapInArrow(lambda it, known=known: _contexts(it, known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        sums = materialise(sums, "op2-beside")
        cells = sums.where("key < 0").toPandas()  # CLASSES ** 2 rows
        table = np.zeros(CLASSES * CLASSES)
        table[-1 - cells["key"].to_numpy(np.int64)] = cells["n"]
        table = table.reshape(CLASSES, CLASSES)
        value = likelihood(table)
        gain = np.inf if best is None else (value - best[0]) / max(abs(best[0]), 1.0)
        if best is None or gain > 0:
            best = value, kinds, table
        if last or gain < TOLERANCE:
            drop(sums)
            break
        of = sent((table, kinds))
        near = sums.where("key >= 0").select(F.expr(f"key div {_SIDES}").alias("name"), F.struct((F.col("key") % _SIDES).cast("int").alias("side"), "n").alias("x"))
        near = near.groupBy("name").agg(F.collect_list("x").alias("x")).select("name", "x.side", "x.n")  # at most _SIDES values a word
        moved = materialise(near.mapInArrow(lambda it, of=of: _move(it, of), "name long, kind int"), "op2-moved")
        put = moved.toArrow()  # at most HEAD words
        drop(sums, moved)
        kinds = kinds.copy()
        kinds[put["name"].to_numpy()] = put["kind"].to_numpy()
    return best[1], best[2]


def _placed(texts: DataFrame, rare: DataFrame, kinds: np.ndarray, of_shape: np.ndarray, table: np.ndarray) -> DataFrame:
    """``rare`` (word, n) with the class of each word seen LEAST times, -1 for others."""
    spark = texts.sparkSession
    of, known = spark.sparkContext.broadcast((table, None)), spark.sparkContext.broadcast((kinds, of_shape))
    near = texts.mapInArrow(lambda it: _rare_contexts(it, known), "word long, side int, n long").groupBy("word", "side").agg(F.sum("n").alias("n"))
    near = near.groupBy("word").agg(F.sum(F.when(F.col("side") < CLASSES, F.col("n"))).alias("all"), F.collect_list(F.struct("side", "n")).alias("x"))  # at most _SIDES values a word
    put = near.where(F.col("all") >= LEAST).select("word", "x.side", "x.n").mapInArrow(lambda it: _move(it, of), "word long, kind int")
    return materialise(rare.join(put, "word", "left").select("word", "n", F.coalesce("kind", F.lit(-1)).alias("kind")), "op2-rare")


def _code_all(rows: DataFrame, name: np.ndarray) -> DataFrame:
    head = rows.sparkSession.sparkContext.broadcast(name)
    id_type = rows.schema["id"].dataType.simpleString()
    return materialise(rows.mapInArrow(lambda it: _code(it, head), f"uid long, id {id_type}, train boolean, codes binary, words array<long>, shapes array<int>"), "op2-coded")


def _resolved(coded: DataFrame, rare: DataFrame) -> DataFrame:
    """Coded texts with the counts and classes of the words that were looked up."""
    looked = coded.select("uid", F.posexplode("words").alias("j", "word"))
    found = looked.join(rare, "word").groupBy("uid").agg(F.collect_list(F.struct("j", "n", "kind")).alias("x"))
    found = found.select("uid", F.col("x.j").alias("j"), F.col("x.n").alias("n"), F.col("x.kind").alias("kind"))
    none = F.array().cast("array<int>")
    out = coded.drop("words").join(found, "uid", "left").drop("uid")
    return materialise(out.withColumns({"j": F.coalesce("j", none), "n": F.coalesce("n", none.cast("array<bigint>")), "kind": F.coalesce("kind", none)}), "op2-resolved")


def _looked_up(c: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Count and own class (-1) of each looked-up word."""
    j, cut = _flat(c.column("j"))
    count, own = np.zeros(len(c.group), np.int64), np.full(len(c.group), -1)
    place = j + np.repeat(c.cut[:-1], np.diff(cut))
    count[place], own[place] = _flat(c.column("n"))[0], _flat(c.column("kind"))[0]
    return count, own


def _steps(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    kinds, of_shape = sent.value
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for c in _coded(it):
        _, own = _looked_up(c)
        kind = c.kinds(kinds, np.where(own < 0, of_shape[c.group], own))
        out += np.bincount(c.before(kind) * CLASSES + kind, minlength=len(out))
    yield pa.record_batch([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["pair", "n"])


def _score(it: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model = sent.value
    known = model.counts > 0
    log_count = np.log10(model.counts + 1.0)
    emission = model.emission(model.kinds, model.groups, model.counts)
    for c in _coded(it):
        count, own = _looked_up(c)
        of = np.where(own < 0, model.of_shape[c.group], own)
        kind = c.kinds(model.kinds, of)
        value = c.kinds(emission, model.emission(of, np.where(own < 0, c.group, -1), count)) + model.step[c.before(kind), kind]
        parts = c.kinds(known, count > 0).astype(np.int64), c.kinds(log_count, np.log10(count + 1.0)), value
        yield pa.record_batch([c.column("id"), pa.array(np.diff(c.first)), *[pa.array(np.add.reduceat(x, c.first[:-1])) for x in parts]], ["id", "n_tokens", "n_known", "logs", "score"])


def _scores(resolved: DataFrame, model: Model) -> DataFrame:
    sent = resolved.sparkSession.sparkContext.broadcast(model)
    out = resolved.mapInArrow(lambda it: _score(it, sent), f"id {resolved.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, logs double, score double")
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1))
    return out.select("id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _rows(docs: DataFrame, id_col: str, text_col: str, trains: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("train"))


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the table (word, n, kind) of its rarer words; kind is the class, -1 for that of the shape."""
    model, rare, resolved = _fit(docs.select(F.lit(None).cast("int").alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(True).alias("train")))
    drop(resolved)
    return model, rare


def score(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    coded = _code_all(_rows(docs, id_col, text_col, F.lit(False)), model.words)
    resolved = _resolved(coded, rare)
    drop(coded)
    return _scores(resolved, model)


def train_and_score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows of ``docs`` by the model of those that ``trains`` selects; texts are coded once for both."""
    model, _, resolved = _fit(_rows(docs, id_col, text_col, trains))
    return _scores(resolved, model)
