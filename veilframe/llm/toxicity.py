"""Toxicity by a counterfactually regularised linear classifier.

Features are the distinct tokens of a text and their prefixes of 4 to 6 bytes, hashed to 64 bits, so
inflected forms share their stem.  All features that are over-represented in toxic texts (z value of at least
EVIDENCE, in ``least`` documents) get weights by regularised logistic regression; words of
harmless text are no evidence against toxicity, however many a long text has.

Counterfactual term.  In every text of the fit that names an identity group, each term is
swapped for each other of its list, and the features of the swapped text are compared with those of the text itself:
what else of the text shares a feature, or holds the other term already, keeps it.  The squared change of the logit,
averaged over the texts, is added to the loss.  Neutral mentions of a group then cannot raise or lower a score by
themselves: what is left comes from the other words.  Identity features are always part of the model, so that the
penalty binds them; every swap also counts in a text of the term alone, with weight SEEDED, so that a term
first seen in scoring is bound to the others as well.

Training takes at most about ``per_class`` labelled rows of each class, chosen by a hash of the id; this
documented bound keeps the fit on the driver small.  Scoring is one pass over whole texts without a
shuffle.

Edge cases: null and empty texts have no features and get the prior score; without labels of both
classes every score is the share of toxic ones (0 if there are none); labels other than 0 and 1 and
null ids are skipped; an id labelled twice counts as toxic if any label says so; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import U64, batches, mix64, odd_constants, signed, words

PER_CLASS = 5000
EVIDENCE = 2.5
SEEDED = 0.01
PREFIXES = (4, 5, 6)
_STOP = np.arange(256, dtype=np.uint8)
_STOP[[c for c in range(128) if not chr(c).isalnum()]] = 0x20

# Terms for groups of people; terms of one list stand for each other.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men", "woman", "man", "female", "male"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("muslime", "christ", "jude", "hindus", "atheisten"),
    ("frauen", "männer", "frau", "mann"),
    ("musulman", "chrétien", "juif", "hindou", "athée"),
    ("femmes", "hommes", "femme", "homme"),
    ("musulmán", "cristiano", "judío", "hindú", "ateo"),
    ("mujeres", "hombres", "mujer", "hombre"),
)


class Model(NamedTuple):
    keys: np.ndarray  # sorted 64-bit features
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of all documents (with repeats), the document and the word of each; the words themselves come first."""
    text = _STOP[data[offs[0] : offs[-1]]]
    w = words(text, offs - offs[0], lower=True, seed=3)
    doc = w.document()
    size = w.end - w.start
    byte = odd_constants(256, 31)
    place = odd_constants(max(PREFIXES), 32)
    keys, places = [w.hash], [np.arange(len(doc))]
    run = np.zeros(len(w.start), U64)
    lower = text | (((text >= 0x41) & (text <= 0x5A)).astype(np.uint8) << np.uint8(5))
    for j in range(max(PREFIXES)):
        at = np.minimum(w.start + j, len(text) - 1)
        run = run + mix64(byte[lower[at]] * place[j]) if len(at) else run
        if j + 1 in PREFIXES:
            long = np.flatnonzero(size > j + 1)
            keys.append(mix64(run[long] + U64(j + 1)))
            places.append(long)
    word = np.concatenate(places)
    return np.concatenate(keys), doc[word], word


def _of_term(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]))[0]


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, docs))
    k, d = keys[order], docs[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    return k[fresh], d[fresh]


def _spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents hold each feature."""
    for batch, data, offs in batches(it):
        toxic = np.asarray(batch.column(batch.schema.get_field_index("toxic"))).astype(bool)
        k, d = _distinct(*features(data, offs)[:2])
        u, inv = np.unique(k, return_inverse=True)
        yield pa.record_batch([pa.array(signed(u)), pa.array(np.bincount(inv, toxic[d], len(u)).astype(np.int64)), pa.array(np.bincount(inv, ~toxic[d], len(u)).astype(np.int64))], ["key", "bad", "good"])


class Lookup:
    """Places of hashes in a small sorted array; a bit map settles nearly all misses."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> U64(44)).astype(np.int64)] = True

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``found`` that hit, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(found >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        ok = self.keys[place] == found[at]
        return at[ok], place[ok]


class Terms:
    """Identity terms: their features, and the others of their lists."""

    def __init__(self) -> None:
        self.lists = [[_of_term(t) for t in group] for group in IDENTITIES]
        self.terms = [(t, [o for o in group if o is not t]) for group in self.lists for t in group]
        self.features = np.unique(np.concatenate([t for t, _ in self.terms]))
        words_ = np.array([t[0] for t, _ in self.terms])  # the word itself is its first feature
        self.order = np.argsort(words_)
        self.look = Lookup(words_[self.order])

    def changes(self, others: np.ndarray, term: int) -> Iterator[tuple[list[int], list[int]]]:
        """Features that go and that come for each swap of a term in a text whose other words have the features ``others``."""
        mine, rest = self.terms[term]
        gone = set(mine[~np.isin(mine, others)].tolist())
        for o in rest:
            new = set(o[~np.isin(o, others)].tolist())
            yield sorted(gone - new), sorted(new - gone)


def _rows(it: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    """Model features of each text, and the changes of each counterfactual text: places from 1, below 0 where one goes."""
    look, terms = Lookup(keys.value), Terms()
    for batch, data, offs in batches(it):
        k, d, w = features(data, offs)
        at, place = look(k)
        p, doc = _distinct(place.astype(U64), d[at])
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        changes: list[list[list[int]]] = [[] for _ in range(batch.num_rows)]
        n = int(w.max()) + 1 if len(w) else 0
        hit, which = terms.look(k[:n])
        for text in np.unique(d[hit]).tolist():
            own = np.flatnonzero(d == text)
            mine = d[hit] == text
            for term in np.unique(which[mine]).tolist():
                others = k[own[~np.isin(w[own], hit[mine & (which == term)])]]
                for gone, new in terms.changes(others, int(terms.order[term])):
                    sides = (-1 - np.searchsorted(keys.value, np.array(gone, U64))).tolist() + (1 + np.searchsorted(keys.value, np.array(new, U64))).tolist()
                    changes[text].append(sides)
        yield pa.record_batch(
            [batch.column(batch.schema.get_field_index("toxic")), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(p.astype(np.int32))), pa.array(changes, pa.list_(pa.list_(pa.int32())))],
            ["toxic", "at", "changes"],
        )


class Swaps(NamedTuple):
    """Changes of features when one identity term takes another's place."""

    places: np.ndarray  # features that any swap touches
    change: np.ndarray  # distinct change x place: +1 goes out, -1 comes in
    weight: np.ndarray  # texts with that change, as a share of all texts


def fit(y: np.ndarray, at: np.ndarray, cut: np.ndarray, swaps: Swaps, shares: tuple[float, float], n: int, ridge: float = 1e-4, counterfactual: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch adaptive gradient steps.

    The loss adds ``counterfactual`` times the mean square of the logit's change over all swaps of the texts.
    """
    w, b = np.zeros(n), float(np.log(max(shares[1], 1e-9) / max(shares[0], 1e-9)))
    weight = np.where(y == 1, shares[1] / max(y.sum(), 1), shares[0] / max((1 - y).sum(), 1))
    size = np.diff(cut)
    row = np.repeat(np.arange(len(y)), size)
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[at], len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(at, np.repeat(err, size), n) + ridge * w
        if len(swaps.places):
            moved = swaps.change @ w[swaps.places]
            g[swaps.places] += 2 * counterfactual * (swaps.change.T @ (swaps.weight * moved))
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.1 * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        b -= step * mb / (vb**0.5 + 1e-9)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, least: int = 4, counterfactual: float = 1.0) -> Model:
    """Fit on at most about ``per_class`` rows of each class of ``labels`` (id, label); ``counterfactual`` weighs the swaps."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad, good = count.get(1, 0), count.get(0, 0)
    if not bad or not good:
        share = min(max(bad / max(bad + good, 1), 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log(share / (1 - share))) if bad + good else -14.0)
    limit = F.when(F.col("toxic") == 1, per_class / bad).otherwise(per_class / good) * (1 << 30)
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < limit))  # about 2 * per_class ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("text", "toxic")

    spread = rows.mapInArrow(_spread, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") + F.col("good") >= least)
    a, c = min(bad, per_class), min(good, per_class)
    p, q = F.col("bad") / a, F.col("good") / c
    z = (p - q) / F.sqrt((F.col("bad") + 1) / a / a + (F.col("good") + 1) / c / c)
    best = spread.select("key", z.alias("z")).where(F.col("z") >= EVIDENCE).toPandas()  # of about 2 * per_class texts, however many there are
    keys = np.unique(np.concatenate([best["key"].to_numpy(np.int64).view(U64), Terms().features]))

    sent = spark.sparkContext.broadcast(keys)
    got: pd.DataFrame = rows.mapInArrow(lambda it: _rows(it, sent), "toxic int, at array<int>, changes array<array<int>>").toPandas()
    y = got["toxic"].to_numpy(float)
    lists = [np.asarray(x, np.int64) for x in got["at"]]
    at = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    swaps = _swaps(keys, Counter(tuple(c) for row in got["changes"] for c in row), len(y))
    w, b = fit(y, at, np.r_[0, np.cumsum([len(x) for x in lists])], swaps, (good / (good + bad), bad / (good + bad)), len(keys), counterfactual=counterfactual)
    return Model(keys, w, b)


def _swaps(keys: np.ndarray, seen: Counter[tuple[int, ...]], rows: int) -> Swaps:
    """All changes that swaps make in the texts, and those of each term alone."""
    terms = Terms()
    weight: Counter[tuple[int, ...]] = Counter({c: n / max(rows, 1) for c, n in seen.items() if c})
    for term in range(len(terms.terms)):
        for gone, new in terms.changes(np.zeros(0, U64), term):
            weight[(*(-1 - np.searchsorted(keys, np.array(gone, U64))).tolist(), *(1 + np.searchsorted(keys, np.array(new, U64))).tolist())] += SEEDED
    places = np.searchsorted(keys, terms.features)
    change = np.zeros((len(weight), len(places)))
    for i, sides in enumerate(weight):
        x = np.array(sides)
        change[i, np.searchsorted(places, np.abs(x) - 1)] = np.where(x < 0, 1, -1)
    return Swaps(places, change, np.array(list(weight.values())))


def _score(it: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    keys, weights, bias = model.value
    look = Lookup(keys)
    for batch, data, offs in batches(it):
        z = np.full(batch.num_rows, bias)
        if offs[-1] > offs[0] and len(keys):
            k, d, _ = features(data, offs)
            at, place = look(k)
            p, d = _distinct(place.astype(U64), d[at])
            z += np.bincount(d, weights[p.astype(np.int64)], batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, sent), f"id {rows.schema['id'].dataType.simpleString()}, score double")
