"""Operators without SQL: brute force, round trips and held-out accuracy."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import bpe, brown_lm, decontamination, language_id, queries_op2, queries_op5, queries_op6, queries_op7, queries_op9, toxicity
from veilframe.llm.textkernel import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT * FROM documents").df()


def rest(i, m):
    return zlib.crc32(str(i).encode()) % m


# language model


def test_base_scores_against_brute_force(spark, documents):
    got = queries_op2.op2_brown_lm(spark, SF).toPandas().set_index("doc_id")
    tokens = {i: t.encode().lower().split() + [b""] for i, t in zip(documents.doc_id, documents.text, strict=True)}
    c = Counter(w for i, ws in tokens.items() if rest(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def _hash(word):
    return int(words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), lower=True).hash[0])


def _word_kinds(model, rare, vocabulary):
    """Class, shape (-1: class of its own) and count of each word, whether sent or looked up."""
    looked = {r["word"]: r for r in rare.collect()}
    out = {}
    for w in vocabulary:
        at = np.flatnonzero(model.words == np.uint64(_hash(w)))
        if len(at):
            i = 1 + int(at[0])
            out[w] = int(model.kinds[i]), int(model.groups[i]), int(model.counts[i])
        else:
            r = looked[int(np.uint64(_hash(w)).astype(np.int64))]
            g = brown_lm.shape(w)
            out[w] = (r["kind"], -1, r["n"]) if r["kind"] >= 0 else (int(model.of_shape[g]), g, r["n"])
    return out


def _is_proper(model, kinds):
    """All words of the vocabulary and the unknown rest of each shape, after any word, have total probability one."""
    assert np.allclose((10**model.step).sum(axis=1), 1)
    total = Counter({0: 10 ** float(model.emission(0, -1, model.counts[0]))})
    for k, g, n in kinds.values():
        total[k] += 10 ** float(model.emission(k, g, n))
    for g in range(brown_lm.GROUPS):  # one unknown word more in every shape
        total[int(model.of_shape[g])] += 10 ** model.inside[g]
    assert all(math.isclose(x, 1, rel_tol=1e-9) for x in total.values())


@pytest.mark.parametrize("head", [1_000_000, 16, 0.001])
def test_class_model_sums_to_one(spark, monkeypatch, head):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    monkeypatch.setattr(brown_lm, "CORE", 6)
    texts = ["the cat sat on the mat.", "the dog sat.", "a cat, a dog, the end"] * 3 + ["once upon THE sea"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, rare = brown_lm.train(df)
    kinds = _word_kinds(model, rare, {w for t in texts for w in t.encode().lower().split()})
    _is_proper(model, kinds)
    assert {w for w, (_, g, _) in kinds.items() if g < 0} == {w for w, (_, _, n) in kinds.items() if n >= brown_lm.LEAST}


@pytest.mark.parametrize("head", [1_000_000, 60])
def test_scores_against_plain_bigrams(spark, monkeypatch, head):
    """``score`` equals class bigrams counted in plain Python with the model's classes, words unseen in training included."""
    monkeypatch.setattr(brown_lm, "HEAD", head)
    base = ["The cat sat on the mat.", "the dog sat; the cat ran!", "a cat, a dog, the end", "a red dog ran on"] * 3 + ["once upon the sea", "", None]
    held = ["the zebra ran home.", "A CAT once sat", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + held)], "doc_id long, text string")
    trains = df.doc_id < len(base)
    got = {r["id"]: r for r in brown_lm.train_and_score(df, trains).collect()}
    model, rare = brown_lm.train(df.where(trains))
    again = {r["id"]: r["score"] for r in brown_lm.score(df, model, rare).collect()}
    texts = [(t or "").encode().lower().split() for t in base + held]
    kinds = _word_kinds(model, rare, {w for t in texts[: len(base)] for w in t})
    for t in texts:
        for w in t:
            kinds.setdefault(w, (int(model.of_shape[brown_lm.shape(w)]), brown_lm.shape(w), 0))
    kinds[b"<end>"] = 0, -1, len(base)
    pairs, mass, used, inside = Counter(), Counter(), Counter(), {g: [0, 0] for g in range(brown_lm.GROUPS)}
    for t in texts[: len(base)]:
        ks = [0, *(kinds[w][0] for w in t), 0]
        pairs.update(zip(ks[:-1], ks[1:], strict=True))
    for k, g, n in kinds.values():
        if g < 0:
            mass[k] += n
            used[k] += 1
        else:
            inside[g][0] += n
            inside[g][1] += n > 0
    for g, (n, _) in inside.items():
        mass[int(model.of_shape[g])] += n
        used[int(model.of_shape[g])] += 1
    whole = sum(mass[k] + 1 for k in used)
    lead = Counter()
    for (a, _), n in pairs.items():
        lead[a] += n

    def plain(t):
        total, a = 0.0, 0
        for w in [*t, b"<end>"]:
            k, g, n = kinds[w]
            total += math.log10((pairs[a, k] + brown_lm.KAPPA * (mass[k] + 1) / whole) / (lead[a] + brown_lm.KAPPA))
            m = mass[k] + brown_lm.ALPHA * used[k]
            if g < 0:
                total += math.log10((n + brown_lm.ALPHA) / m)
            else:
                total += math.log10((inside[g][0] + brown_lm.ALPHA) / m * (n + 1) / (inside[g][0] + inside[g][1] + 1))
            a = k
        return total

    for i, t in enumerate(texts):
        assert math.isclose(got[i].score, plain(t), rel_tol=1e-9) and math.isclose(again[i], got[i].score, rel_tol=1e-9)


def test_one_word_moves_where_it_gains_most():
    """The sparse gains equal likelihoods computed anew, where a word's neighbours are in other classes than it can move to."""
    rng = np.random.default_rng(4)
    c = brown_lm.CLASSES
    table = rng.integers(1, 50, (c, c)).astype(float)
    side = np.array([3, 5, c + 3, c + 7])
    n = np.array([4.0, 2.0, 3.0, 3.0])
    without = table.copy()
    without[[3, 5], 9] += 0
    held = table.copy()
    held[3, 9] += 4
    held[5, 9] += 2
    held[9, 3] += 3
    held[9, 7] += 3

    def at(k):
        t = without.copy()
        t[3, k] += 4
        t[5, k] += 2
        t[k, 3] += 3
        t[k, 7] += 3
        return brown_lm.likelihood(t)

    free = [k for k in range(1, c) if k not in (3, 5, 7)]
    best = max(free, key=at)
    zero = np.zeros(4, np.int64)
    one = int(brown_lm.best_classes(zero, side, n, np.array([9]), held)[0])
    new = int(brown_lm.best_classes(zero, side, n, np.array([-1]), table)[0])
    assert one == new and (one in (3, 5, 7) or one == best)


def test_rare_words_are_joined(spark, monkeypatch):
    texts = ["aa bb cc aa", "aa dd", "", None, "ee ee"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    want = brown_lm.score(df, *brown_lm.train(df.limit(3))).toPandas().sort_values(["id", "score"]).reset_index(drop=True)
    assert len(want) == 6 and want.n_tokens.tolist()[:2] == [5, 5] and want.score[0] == want.score[1]
    empty = df.where("false")
    got = brown_lm.score(df, *brown_lm.train(empty)).toPandas()
    assert (got.base_score == 0).all() and (got.n_known == 0).all() and np.isfinite(got.score).all()
    assert brown_lm.score(empty, *brown_lm.train(df)).count() == 0


def test_words_under_the_core_have_classes_of_their_own(spark, monkeypatch):
    """Words of one shape that stand in different places get different classes, sent or looked up."""
    for head in (1_000_000, 16):
        monkeypatch.setattr(brown_lm, "HEAD", head)
        monkeypatch.setattr(brown_lm, "CORE", 16)
        texts = [f"the {x}ing ran was {y}ing now" for x, y in ("ab", "cd", "ef", "gh")] * 6 + ["the dog ran was sat now"] * 24
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        model, rare = brown_lm.train(df)
        kinds = _word_kinds(model, rare, {w for t in texts for w in t.encode().split()})
        one, two = ({kinds[f"{w}ing".encode()][0] for w in ws} for ws in ("aceg", "bdfh"))
        assert min(one | two) > 0 and not one & two and model.assigned > 0.8
        _is_proper(model, kinds)


def test_long_words_and_texts_are_scored(spark):
    texts = ["x" * 3_000_000 + " y", "word " * 400_000, "." * 3000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = brown_lm.score(df, *brown_lm.train(df)).toPandas().sort_values("id")
    assert got.n_tokens.tolist() == [3, 400_001, 2, 2] and (got.n_known == got.n_tokens).all() and np.isfinite(got.score).all()


def test_exchange_separates_alternating_groups():
    pairs = np.zeros((9, 9))
    for a in range(1, 5):
        for b in range(5, 9):
            pairs[a, b] = pairs[b, a] = 10
    a, b = np.nonzero(pairs)
    of = brown_lm.exchange(brown_lm.Pairs(a, b, pairs[a, b], 9), classes=3)
    assert len(set(of[1:5])) == 1 and len(set(of[5:])) == 1 and of[1] != of[5] and of[0] == 0


# toxicity


def test_toxicity_learns_words_and_ignores_groups(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        group = "muslim" if bad else "quiet"  # toxic texts name one group only
        rows.append((i, f"text number{i} about {group} people " + ("you total fool" if bad else "and the weather")))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    probe = spark.createDataFrame([(1, "a muslim family"), (2, "a christian family"), (3, "what you total fool"), (4, None), (5, ""), (6, "the weather")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    assert got[3] > 0.5 and got[6] < 0.5 and got[4] == got[5] < 0.5
    free = toxicity.Model(model.keys, model.weights, model.bias)
    term = toxicity._of_term
    logit = lambda t: free.weights[np.searchsorted(free.keys, term(t))].sum()
    assert abs(logit("muslim") - logit("christian")) < 1.0


def test_swaps_equal_features_of_swapped_texts():
    """Changes found from words equal those of the texts with the term replaced, features computed anew."""
    import re

    terms = toxicity.Terms()
    names = [t for group in toxicity.IDENTITIES for t in group]
    feats = lambda t: set(toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist())
    keys = np.sort(np.unique(np.concatenate([terms.features])))
    for text in ("a muslim met a christian, a Muslim", "women and men; womens manners", "the christ of christmas", "black whitewash white", "nothing here"):
        import pyarrow as pa

        batch = pa.record_batch([pa.array([0], pa.int32()), pa.array([text])], ["toxic", "text"])
        got = [tuple(c) for r in toxicity._rows(iter([batch]), type("B", (), {"value": keys})()) for c in r.column(2).to_pylist()[0]]
        want = []
        for g, group in enumerate(toxicity.IDENTITIES):
            for t in group:
                if re.search(rf"(?i)\b{t}\b", text):
                    for o in group:
                        if o != t:
                            gone, new = feats(text) - feats(re.sub(rf"(?i)\b{t}\b", o, text)), feats(re.sub(rf"(?i)\b{t}\b", o, text)) - feats(text)
                            want.append((*(-1 - np.searchsorted(keys, np.array(sorted(gone), np.uint64))).tolist(), *(1 + np.searchsorted(keys, np.array(sorted(new), np.uint64))).tolist()))
        assert sorted(got) == sorted(want)
    assert len(names) == len(terms.terms)


def test_counterfactuals_spare_neutral_mentions(spark):
    """Where toxic texts name one group, the penalty lowers the score of neutral mentions and keeps what is toxic."""
    rnd = np.random.default_rng(6)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words_ = list(rnd.choice(plain, 8)) + (["muslim"] if bad and i % 6 == 0 else []) + (["idiots"] if bad and i % 2 else ["vermin"] if bad else [])
        rows.append((i, " ".join(words_)))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [(i, f"the muslim family {' '.join(rnd.choice(plain, 6))}") for i in range(50)]
    foul = [(100 + i, f"these idiots {' '.join(rnd.choice(plain, 6))}") for i in range(50)]
    probe = spark.createDataFrame(neutral + foul, "doc_id long, text string")
    rate = {}
    for weight in (0.0, 1.0):
        got = toxicity.score(probe, toxicity.learn(docs, labels, counterfactual=weight)).toPandas()
        rate[weight] = (got[got.id < 100].score.mean(), (got[got.id < 100].score >= 0.5).mean(), (got[got.id >= 100].score >= 0.5).mean())
    assert rate[0.0][1] == 1 and rate[1.0][1] == 0 and rate[1.0][0] < rate[0.0][0] and rate[1.0][2] == 1


def test_toxicity_without_labels(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.learn(odd, labels)).toPandas()
    assert len(got) == odd.count() and (got.score < 0.01).all()
    assert toxicity.score(nothing, toxicity.learn(nothing, labels)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert (toxicity.score(odd, toxicity.learn(odd, one)).toPandas().score > 0.5).all()


def test_toxicity_held_out(spark, duck):
    got = queries_op5.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    labels = duck.sql("SELECT * FROM '/root/testdata/sf0.1/labels.parquet'").df()
    labels = labels[[rest(i, 5) == 0 for i in labels.doc_id]]
    got = got.loc[labels.doc_id]
    assert got.held_out.all()
    toxic = labels.toxic.to_numpy() == 1
    assert got.predicted.to_numpy()[toxic].mean() > 0.85 and got.predicted.to_numpy()[~toxic].mean() < 0.01


# BPE


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries_op6.tokenizer_file())
    got = queries_op6.op6_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_texts(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = queries_op6.tokenizer_file()
    lib, vocab = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rng = np.random.default_rng(2)
    pieces = ["<|endoftext|>", "'s", "'S", "aaaaaaa", "\n\n", " ", "\u3000", "\x85", "é", "1", "٣", "\u0558", "\U000323b0", "\u0301", "a\u200bb", "\x1c", "\xa0 "]
    for _ in range(400):
        text = "".join(rng.choice(pieces + [chr(c) for c in rng.integers(1, 0xD7FF, 10)], rng.integers(0, 20)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == ids
    vocab.table = vocab.table | {str(i): b"" for i in range(bpe.TABLE)}  # full: it becomes the old table
    for text in ("hello there", "hello you there"):
        assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == lib.encode(text).ids
    assert len(vocab.table) < 10 and len(vocab.old) >= bpe.TABLE
    out = bpe.encode(odd, path, check=True).toPandas()
    assert len(out) == odd.count() and out.exact.all() and (out.n_tokens == out.ids.map(len) // 4).all()
    assert bpe.decode(bpe.encode(nothing, path), path).count() == 0


def test_bpe_of_huge_words(spark):
    from tokenizers import Tokenizer

    path = queries_op6.tokenizer_file()
    lib, vocab = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("etaoinsrhl"), 100_000))
    for text in (long, "ab" * 40_000, "a" * 70_001, "x" + "aab" * 30_000 + " the " + long[:5000], "-" * 50_000, "\u00e9\u00e8" * 20_000):
        assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    huge = "".join(rng.choice(list("etaoinsrhl"), 1_000_000)) * 4
    df = spark.createDataFrame([(1, huge), (2, "word " * 800_000), (3, "a" * 4_000_000)], "doc_id long, text string")
    got = bpe.encode(df, path, check=True).toPandas()
    assert got.exact.all() and got.n_tokens[got.id == 2].item() > 800_000


# language ID


def test_languages_held_out(spark, documents):
    got = queries_op7.op7_language_id(spark, SF).toPandas().set_index("doc_id")
    assert (got.held_out == [rest(i, 3) == 1 for i in got.index]).all()
    want = documents.set_index("doc_id").lang.loc[got.index]
    assert (got.lang_pred == want)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_mixtures_and_odd_texts(spark, odd, nothing, documents):
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    by = documents.sort_values("n_chars").groupby("lang").text.last()
    mixed = by["en"][:2000] + "\n" + by["fr"][:1500]
    df = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "12 ... 34"), (5, "中"), (6, by["de"][:800])], "doc_id long, text string")
    got = language_id.identify(df, model).toPandas().set_index("id")
    assert got.lang_pred[1] == "en" and 0.45 < got.score[1] < 0.8 and dict(got["shares"][1]).keys() == {"en", "fr"}
    assert got.lang_pred[[2, 3, 4]].tolist() == ["und"] * 3 and got.score[[2, 3, 4]].tolist() == [0] * 3
    assert got.lang_pred[5] != "und" and got.lang_pred[6] == "de"
    assert language_id.identify(odd, model).count() == odd.count()
    blank = language_id.learn(nothing)
    assert set(language_id.identify(odd, blank).toPandas().lang_pred) == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_infer_against_plain_em():
    rng = np.random.default_rng(8)
    score = rng.normal(0, 3, (40, 3))
    share = np.full(3, 1 / 3)
    like = np.exp(score - score.max(axis=1, keepdims=True))
    for _ in range(language_id.ROUNDS):
        r = like * share
        share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    got, _ = language_id._mixture(like, np.array([0, 40]), np.ones((1, 3)))
    assert np.allclose(got[0], share)

def _plain_choice(score):
    """Best penalised set by plain EM until nothing moves: sets grow by the shares of the full mixture."""
    like = np.exp(score - score.max(axis=1, keepdims=True))
    n, langs = like.shape

    def em(allowed):
        share = np.where(np.isin(np.arange(langs), allowed), 1 / len(allowed), 0)
        for _ in range(5000):
            r = like * share
            share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((like * share).sum(axis=1)).sum()

    order = np.argsort(-em(range(langs))[0], kind="stable")
    tried = [em([i]) for i in range(langs)]
    best = max(tried, key=lambda x: x[1])
    for k in range(2, langs + 1):
        share, fit = em(order[:k])
        tried.append((share, fit - 0.5 * (k - 1) * np.log(max(n, 2))))
        best = max(best, tried[-1], key=lambda x: x[1])
    return best[0], [value for _, value in tried]


@pytest.mark.parametrize("langs", [2, 5])
def test_sets_of_languages_by_brute_force(langs):
    rng = np.random.default_rng(langs)
    docs = []
    for d in range(60):
        spoken = rng.choice(langs, 1 + d % min(langs, 3), replace=False)
        word = rng.choice(spoken, int(rng.integers(1, 80)))
        score = rng.normal(0, 1, (len(word), langs))
        score[np.arange(len(word)), word] += rng.choice([0.3, 1.5, 4.0])
        docs.append(score)
    got = language_id.infer(np.concatenate(docs), np.r_[0, np.cumsum([len(s) for s in docs])])
    sets = set()
    for s, mine in zip(docs, got, strict=True):
        want, values = _plain_choice(s)
        top = sorted(values)[-2:]
        if top[1] - top[0] < 2 * language_id.GAP:
            continue  # a tie within the bound of the search
        assert ((mine > 1e-3) == (want > 1e-3)).all() and np.allclose(mine, want, atol=0.02)
        sets.add(int((want > 1e-3).sum()))
    assert len(sets) > 1


def test_settled_mixtures_are_within_the_gap():
    rng = np.random.default_rng(3)
    like = np.exp(rng.normal(0, 0.05, (400, 6))).astype(np.float32)  # close models: EM is slow
    like /= like.max(axis=1, keepdims=True)
    first, every = np.array([0, 1, 150, 400]), np.ones((3, 6), np.float32)
    share, fit, gap = language_id._settle(like, first, every, language_id._mixture(like, first, every)[0])
    for d in range(3):
        part = like[first[d] : first[d + 1]].astype(float)
        plain = np.full(6, 1 / 6)
        for _ in range(20000):
            r = part * plain
            plain = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        best = np.log((part * plain).sum(axis=1)).sum()
        assert fit[d] - 1e-3 <= best <= fit[d] + gap[d] + 1e-3 and share[d].sum() == pytest.approx(1)


# decontamination


def test_passages_are_found_and_nothing_else(spark, duck):
    import re

    sf = "/root/testdata/sf0.1"
    got = set(queries_op9.op9_template_decontamination(spark, sf).toPandas().doc_id)
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(t) for (t,) in duck.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    want = {i for i, t in duck.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall() for x in [plain(t)] if any(b in x for b in items)}
    assert got == want


def test_replaced_slots_are_caught(spark):
    item = "A farmer named Bob bought 12 apples and sold 5 of them to Alice, so Bob walked 3 km with the 12 apples on his back today"
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (3, "too short here")], "item_id long, text string")
    swap = "so. A farmer named Tim bought 1,300 apples and sold 2.5 of them to Jane, so Tim walked 9 miles with the 1,300 apples on his back today"
    clash = "A farmer named Tim bought 30 apples and sold 30 of them to Tim, so Jane walked 30 km with the 31 apples on his back"
    texts = {1: swap, 2: item.upper(), 3: clash, 4: "A farmer bought some apples.", 5: None, 6: "", 7: "too short here", 8: item}
    rows = [(i, t) for i, t in texts.items()] + [(8, item), (None, item)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).toPandas().set_index("id")
    assert set(got.index) == {1, 2, 8} and set(got["item"]) == {7}
    assert decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench.where("false")).count() == 0


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = odd.select(odd.doc_id.alias("item_id"), "text")
    got = decontamination.contaminated(odd, bench).toPandas().set_index("id")
    assert set(got.index) == {1, 2, 6, 7, 13} and got["item"][[1, 2, 6]].tolist() == [1, 1, 1]
    assert decontamination.contaminated(nothing, bench).count() == 0


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return decontamination.contaminated(docs, bench).toPandas().set_index("id")


def test_number_dense_copies_are_found(spark):
    table = "Rows 1 2 3 4 5 then 6 7 8 9 10 and 11 12 13 14 15 end"
    items = {1: "Compute 12 + 7 * 3 - 8 / 4", 2: table}
    texts = {1: "Now compute 12 + 7 * 3 - 8 / 4, please", 2: "See: " + table, 3: "Compute 12 + 7 * 3 - 8 / 5", 4: table.replace("8", "80")}
    got = leaks(spark, texts, items)
    assert got["item"].to_dict() == {1: 1, 2: 2} and got.n_windows.to_dict() == {1: 1, 2: 7} and got.first_token.to_dict() == {1: 1, 2: 1}


def family(*numbers):
    """Twenty tokens with numbers at 0, 6, 13 and 19."""
    return "{} red birds sat on roofs {} blue fish swam in lakes today {} old bears ate ripe plums {}".format(*numbers)


def test_siblings_of_one_template_are_found(spark):
    items = {1: family(3, 5, 3, 9), 2: family(3, 5, 7, 9), 3: family(4, 6, 8, 1)}
    texts = {1: family(3, 5, 3, 9), 2: family(3, 5, 7, 9), 3: family(2, 11, 12, 13), 4: family(2, 11, 2, 13), 5: family(4, 6, 8, 1)}
    got = leaks(spark, texts, items)
    assert got["item"][[1, 2, 3, 4]].to_dict() == {1: 1, 2: 1, 3: 2, 4: 1} and set(got.index) == set(texts)
    assert (got.n_windows == 8).all() and (got.first_token == 0).all()


def test_contradictions_take_their_own_windows_only(spark):
    middle = " so they ran home and slept until the rain had gone away again "
    other = "{} tall trees stood near rivers {} small goats ran over hills then {} young wolves hid under stones {}".format
    item = family(3, 5, 7, 9) + middle + other(11, 12, 13, 14)
    texts = {
        1: family(3, 5, 7, 9) + middle + other(11, 12, 13, 9),  # 14 becomes a value already used
        2: family(30, 50, 70, 90) + middle + other(110, 120, 130, 90),
        3: family(2, 2, 2, 2) + " so they ran off",
    }
    got = leaks(spark, texts, {1: item})
    assert set(got.index) == {1, 2} and (got["item"] == 1).all()
    # of 41 windows, those of document 2 with token 19 or 52 have a contradicted pair
    assert got.n_windows.to_dict() == {1: 40, 2: 27} and (got.first_token == 0).all()
