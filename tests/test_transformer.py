"""The scorer against a loop in double precision, and its invariances."""

import numpy as np
import pytest

from veilframe.operators.segments import cut, pack
from veilframe.operators.transformer import Dims, Transformer, TransformerScorer, rope_tables, route
from veilframe.plans.seeded import seeded_tensors
from veilframe.sources.tensors import TensorFile, narrow, widen, write_tensors

DIMS = Dims(d=16, layers=2, heads=4, kv_heads=2, head=8, experts=6, top=4, ff=12, vocab=50, band=3)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("w") / "m.safetensors")
    write_tensors(p, seeded_tensors(DIMS, 1))
    return p


def naive(tensors, dims, ids):
    """Token by token, one number at a time where it matters."""
    w = {k: (widen(v) if v.dtype == np.uint16 else v).astype(float) for k, v in tensors.items()}
    n = len(ids)
    cos, sin = (t.astype(float) for t in rope_tables(n, dims.head))
    norm = lambda v, s: v / np.sqrt((v * v).mean() + 1e-5) * s
    x = [w["embedding.weight"][i].copy() for i in ids]
    for layer in range(dims.layers):
        g = lambda name, layer=layer: w[f"block.{layer}.{name}"]
        qs, ks, vs = [], [], []
        for t in range(n):
            y = g("attn.qkv.weight") @ norm(x[t], g("attn.norm.scale")) + g("attn.qkv.bias")

            def turned(v, t=t):
                v = v.reshape(-1, dims.head).copy()
                for h in range(len(v)):
                    for i in range(dims.head // 2):
                        a, b = v[h, 2 * i], v[h, 2 * i + 1]
                        v[h, 2 * i], v[h, 2 * i + 1] = a * cos[t, i] - b * sin[t, i], b * cos[t, i] + a * sin[t, i]
                return v * dims.head**-0.25

            qs.append(turned(y[: dims.q]))
            ks.append(turned(y[dims.q : dims.q + dims.kv]))
            vs.append(y[dims.q + dims.kv :].reshape(-1, dims.head))
        for t in range(n):
            out = []
            for h in range(dims.heads):
                kv = h // (dims.heads // dims.kv_heads)
                near = [j for j in range(n) if abs(j - t) <= dims.band]
                e = np.exp([qs[t][h] @ ks[j][kv] for j in near])
                out.append(sum(a * vs[j][kv] for a, j in zip(e, near, strict=True)) / (e.sum() + 2 ** g("attn.sinks")[h]))
            x[t] = x[t] + g("attn.out.weight") @ np.concatenate(out) + g("attn.out.bias")
            z = norm(x[t], g("mlp.norm.scale"))
            logits = g("mlp.gate.weight") @ z + g("mlp.gate.bias")
            top = sorted(range(dims.experts), key=lambda i: (-logits[i], i))[: dims.top]
            gates = np.exp(logits[top]) / np.exp(logits[top]).sum()
            total = 0
            for e_, gate in zip(top, gates, strict=True):
                h1 = z @ g("mlp.swiglu.weight")[e_] + g("mlp.swiglu.bias")[e_]
                a, b = np.minimum(h1[: dims.ff], 7), np.clip(h1[dims.ff :], -7, 7)
                total = total + gate * ((a / (1 + np.exp(-1.702 * a)) * (b + 1)) @ g("mlp.out.weight")[e_] + g("mlp.out.bias")[e_])
            x[t] = x[t] + total
    out = np.array([w["unembedding.weight"] @ norm(v, w["norm.scale"]) for v in x])
    return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def test_forward_equals_loop(path):
    ids = np.random.default_rng(0).integers(0, DIMS.vocab, 11)
    got = Transformer(TensorFile(path), DIMS).forward(ids, [len(ids)])
    assert np.allclose(got, naive(seeded_tensors(DIMS, 1), DIMS, ids), atol=2e-4)


def test_packing_does_not_matter(path):
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, DIMS.vocab, n) for n in (0, 5, 17, 1, 30, 8)]
    results = [TransformerScorer(path, DIMS, 10, budget)([""] * 6, ids, []) for budget in (10, 25, 1000)]
    assert all(np.allclose(results[0], r, atol=1e-5) for r in results[1:])
    assert results[0].shape == (61, 33)
    assert TransformerScorer(path, DIMS, 10, 10)([], [], []).shape == (0, 33)


def test_rounding_and_skipping(path):
    ids = np.arange(9)
    plain = Transformer(TensorFile(path), DIMS).forward(ids, [9])
    assert np.allclose(plain, Transformer(TensorFile(path), DIMS, round_activations=True).forward(ids, [9]), atol=0.2)
    chosen, weight = route(np.array([[3.0, 3.0, 0.0, 2.9, -9.0]]), 4)
    assert chosen.tolist() == [[0, 1, 3, 2]] and np.isclose(weight.sum(), 1)
    chosen, weight = route(np.array([[3.0, 3.0, 0.0, 2.9, -9.0]]), 4, 0.5)
    assert chosen.tolist() == [[0, 1, 3, -1]] and np.isclose(weight.sum(), 1)


def test_windows_and_batches():
    assert cut(np.array([0, 3, 7]), 3) == [(1, 0, 3), (2, 0, 3), (2, 3, 3), (2, 6, 1)]
    assert pack([3, 3, 3, 1, 4], 6) == [[0, 1], [2, 3], [4]]


def test_tensor_file_is_checked(path):
    f = TensorFile(path)
    with pytest.raises(KeyError):
        f.get("nothing", "F32", (1,))
    with pytest.raises(ValueError):
        f.get("norm.scale", "BF16", (17,))
    x = np.array([1.0, -2.5, 3.1415927, 1e-30], np.float32)
    assert np.allclose(widen(narrow(x)), x, rtol=2**-8)
