"""Search, runs and selection against plain versions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from veilframe.functions.spans import mask, select_spans
from veilframe.operators import span_lists
from veilframe.operators.decode import argmax_labels, label_runs, transition_matrix, viterbi
from veilframe.schema import CATEGORIES, N_LABELS, label_of

CLOSED = (-1, 2, 3)


def plain_viterbi(lp):
    """Step by step over a full transition matrix."""
    t = transition_matrix()
    tags = np.array([-1] + [(x - 1) % 4 for x in range(1, N_LABELS)])
    wall = np.float32(-1e9)
    s = lp[0] + np.where(np.isin(tags, (-1, 0, 3)), np.float32(0), wall)
    back = []
    for row in lp[1:]:
        v = s[:, None] + t
        back.append(v.argmax(axis=0))
        s = v.max(axis=0) + row
    out = [int((s + np.where(np.isin(tags, CLOSED), np.float32(0), wall)).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_viterbi_equals_full_matrix():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 40, 60)
    lp = np.log(rng.dirichlet(np.full(N_LABELS, 0.3), sizes.sum()) + 1e-9).astype(np.float32)
    offs = np.r_[0, np.cumsum(sizes)]
    got = viterbi(lp, offs)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        if b > a:
            assert got[a:b].tolist() == plain_viterbi(lp[a:b])


def test_viterbi_is_best_of_all_paths():
    rng = np.random.default_rng(4)
    allowed = transition_matrix() == 0
    few = [0, *range(1, 9)]
    for n in (1, 2, 3, 4):
        lp = np.full((n, N_LABELS), -50, np.float32)
        lp[:, few] = rng.standard_normal((n, len(few)))
        tag = lambda x: -1 if x == 0 else (x - 1) % 4
        paths = [p for p in itertools.product(few, repeat=n) if tag(p[0]) in (-1, 0, 3) and tag(p[-1]) in CLOSED and all(allowed[a, b] for a, b in itertools.pairwise(p))]
        best = max(paths, key=lambda p: sum(float(lp[i, x]) for i, x in enumerate(p)))
        assert tuple(viterbi(lp, np.array([0, n]))) == best


def test_viterbi_edges():
    assert viterbi(np.zeros((0, N_LABELS), np.float32), np.array([0])).tolist() == []
    assert viterbi(np.zeros((3, N_LABELS), np.float32), np.array([0, 0, 3])).tolist() == [0, 0, 0]
    assert argmax_labels(np.eye(N_LABELS, dtype=np.float32)[[5, 0]]).tolist() == [5, 0]


def machine(labels):
    """Open, extend and close one run at a time."""
    runs, cur = [], None
    for i, x in enumerate(labels):
        cat, tag = (x - 1) // 4, (x - 1) % 4
        goes_on = x and cur and cur[0] == cat and tag in (1, 2)
        if goes_on:
            cur[2] = i
        else:
            if cur:
                runs.append(tuple(cur))
            cur = [cat, i, i] if x else None
        if cur and tag in (2, 3):
            runs.append(tuple(cur))
            cur = None
    return runs + ([tuple(cur)] if cur else [])


def test_runs_of_random_labels():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        labels = rng.choice([0, *range(1, 13)], rng.integers(0, 12)).astype(np.uint8)
        got = label_runs(labels, np.array([0, len(labels)]))
        assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == machine(labels.tolist())


def test_runs_stop_at_documents():
    labels = np.array([label_of(2, 0), label_of(2, 1), label_of(2, 1)], np.uint8)
    assert [x.tolist() for x in label_runs(labels, np.array([0, 2, 3]))] == [[2, 2], [0, 2], [1, 2]]


def greedy(spans):
    kept = []
    for label in CATEGORIES:
        for s in sorted((x for x in spans if x["label"] == label), key=lambda x: (x["start"], -x["end"])):
            if all(s["end"] <= k["start"] or s["start"] >= k["end"] for k in kept if k["label"] == label):
                kept.append(s)
    out, at = [], 0
    for s in sorted(kept, key=lambda x: (x["start"], -x["end"], x["label"])):
        if s["start"] >= at and s["end"] > s["start"]:
            out.append(s)
            at = s["end"]
    return out


def test_selection_forms_agree(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        spans = [{"label": CATEGORIES[rng.integers(4)], "start": int(a), "end": int(a + rng.integers(1, 9))} for a in rng.integers(0, 40, rng.integers(0, 12))]
        rows.append((i, spans))
    df = spark.createDataFrame(rows, "id int, raw array<struct<label:string,start:int,end:int>>")
    got = {r["id"]: [x.asDict() for x in r["s"]] for r in df.select("id", select_spans(F.col("raw"), CATEGORIES).alias("s")).collect()}
    for i, spans in rows:
        assert got[i] == greedy(spans) == span_lists.select(spans)


def test_no_span_is_dropped_by_default(spark):
    spans = [{"label": "secret", "start": 3 * i, "end": 3 * i + 2} for i in range(600)]
    df = spark.createDataFrame([(spans,)], "raw array<struct<label:string,start:int,end:int>>")
    assert df.select(F.size(select_spans(F.col("raw"), CATEGORIES)), F.size(select_spans(F.col("raw"), CATEGORIES, 512))).first()[:] == (600, 512)


def test_mask_keeps_other_bytes(spark):
    text = "aéb \U0001f600 mail\n"
    spans = [{"label": "secret", "start": 1, "end": 3}, {"label": "private_email", "start": 10, "end": 14}]
    df = spark.createDataFrame([(text, spans), ("x", []), (None, None)], "t string, s array<struct<label:string,start:int,end:int>>")
    out = [r[0] for r in df.select(mask(F.col("t"), F.col("s"))).collect()]
    assert out[0] == "a<SECRET>b \U0001f600<PRIVATE_EMAIL>l\n" or out[0] == span_lists.mask(text, spans)
    assert out[0] == span_lists.mask(text, spans)
    assert out[1:] == ["x", None]


def test_well_formed_best_labels_need_no_search(monkeypatch):
    """Documents whose best labels are a path of their own give what the search gives."""
    from veilframe.operators import decode

    rng = np.random.default_rng(0)
    agreed = 0
    for _ in range(40):
        sizes = rng.integers(0, 30, 20)
        offsets = np.r_[0, np.cumsum(sizes)]
        labels = np.zeros(offsets[-1], int)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            i = a
            while i < b:
                kind, c = rng.integers(0, 3), 1 + 4 * rng.integers(0, 8)
                if kind == 1:
                    labels[i] = c + 3
                elif kind == 2 and i + 2 < b:
                    labels[i : i + 3] = c, c + 1, c + 2
                    i += 2
                i += 1
        lp = rng.normal(0, 0.3, (offsets[-1], 33)).astype(np.float32)
        lp[np.arange(len(labels)), labels] += rng.choice([0.5, 1.0, 2.0])
        with monkeypatch.context() as m:
            agreed += decode._agreed(lp, offsets, np.zeros(len(lp), np.uint8)).sum()
            got = decode.viterbi(lp, offsets)
            m.setattr(decode, "_agreed", lambda lp, o, out: np.zeros(len(o) - 1, bool))
            assert (got == decode.viterbi(lp, offsets)).all()
    assert agreed > 100
