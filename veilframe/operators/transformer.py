"""Banded mixture-of-experts transformer over packed windows, in numpy.

Windows of several documents are packed into one call.  Attention is bidirectional within a band and never leaves a
window, positions restart in each window, and everything else is per token, so results do not depend on
packing beyond float rounding.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..schema import N_LABELS
from ..sources.tensors import TensorFile, narrow, widen
from .segments import cut, pack


@dataclass(frozen=True)
class Dims:
    """Model sizes; the defaults are the full model's, tests use small ones."""

    d: int = 640
    layers: int = 8
    heads: int = 14
    kv_heads: int = 2
    head: int = 64
    experts: int = 128
    top: int = 4
    ff: int = 640
    vocab: int = 200064
    band: int = 128
    classes: int = N_LABELS

    @property
    def q(self) -> int:
        return self.heads * self.head

    @property
    def kv(self) -> int:
        return self.kv_heads * self.head

    def shapes(self) -> dict[str, tuple[str, tuple[int, ...]]]:
        """Tensor names with dtype and shape."""
        out = {"embedding.weight": ("BF16", (self.vocab, self.d)), "norm.scale": ("BF16", (self.d,)), "unembedding.weight": ("BF16", (self.classes, self.d))}
        for i in range(self.layers):
            for name, kind, shape in (
                ("attn.norm.scale", "BF16", (self.d,)),
                ("attn.qkv.weight", "BF16", (self.q + 2 * self.kv, self.d)),
                ("attn.qkv.bias", "BF16", (self.q + 2 * self.kv,)),
                ("attn.sinks", "F32", (self.heads,)),
                ("attn.out.weight", "BF16", (self.d, self.q)),
                ("attn.out.bias", "BF16", (self.d,)),
                ("mlp.norm.scale", "BF16", (self.d,)),
                ("mlp.gate.weight", "BF16", (self.experts, self.d)),
                ("mlp.gate.bias", "BF16", (self.experts,)),
                ("mlp.swiglu.weight", "BF16", (self.experts, self.d, 2 * self.ff)),
                ("mlp.swiglu.bias", "BF16", (self.experts, 2 * self.ff)),
                ("mlp.out.weight", "BF16", (self.experts, self.ff, self.d)),
                ("mlp.out.bias", "BF16", (self.experts, self.d)),
            ):
                out[f"block.{i}.{name}"] = (kind, shape)
        return out


def dims_of(tensors: TensorFile) -> Dims:
    """Sizes of a model file from the shapes of its tensors; experts per token and band are not stored and keep their defaults."""
    shape = lambda name: tuple(tensors.header[name]["shape"]) if name in tensors.header else ()
    try:
        (vocab, d), (classes, _) = shape("embedding.weight"), shape("unembedding.weight")
        layers = len({n.split(".")[1] for n in tensors.header if n.startswith("block.")})
        (heads,), (_, q), (rows, _) = shape("block.0.attn.sinks"), shape("block.0.attn.out.weight"), shape("block.0.attn.qkv.weight")
        experts, ff, _ = shape("block.0.mlp.out.weight")
    except ValueError:
        raise ValueError("not a model file: tensors are missing or have other ranks") from None
    head = q // heads
    return Dims(d=d, layers=layers, heads=heads, kv_heads=(rows - q) // 2 // head, head=head, experts=experts, ff=ff, vocab=vocab, classes=classes)


# Fixed values of the model's position scaling and activation.
THETA, FACTOR, ORIGINAL, SLOW, FAST = 150000.0, 32.0, 4096.0, 1.0, 32.0
LIMIT, GATE_SLOPE, EPS = 7.0, 1.702, 1e-5


def rope_tables(n: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine per position and pair, frequencies blended between interpolation and extrapolation."""
    half = head // 2
    pair = np.arange(half)
    rate = THETA ** (-2.0 * pair / head)
    edge = lambda turns: half * np.log(ORIGINAL / (turns * 2 * np.pi)) / np.log(THETA)
    low, high = edge(FAST), edge(SLOW)
    blend = np.clip((pair - low) / (high - low), 0.0, 1.0)
    rate = rate * (1 - blend) + rate / FACTOR * blend
    gain = 0.1 * np.log(FACTOR) + 1.0
    angle = np.arange(n)[:, None] * rate
    return (np.cos(angle) * gain).astype(np.float32), (np.sin(angle) * gain).astype(np.float32)


def rms_norm(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + np.float32(EPS)) * scale


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Interleaved pairs of (tokens, heads, head) by per-token tables."""
    out = np.empty_like(x)
    even, odd = x[..., 0::2], x[..., 1::2]
    out[..., 0::2] = even * cos[:, None] - odd * sin[:, None]
    out[..., 1::2] = odd * cos[:, None] + even * sin[:, None]
    return out


def swiglu(x: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    gate, lin = np.minimum(x[..., :half], LIMIT), np.clip(x[..., half:], -LIMIT, LIMIT)
    return gate / (1 + np.exp(-GATE_SLOPE * gate)) * (lin + 1)


def route(logits: np.ndarray, top: int, skip_beta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Chosen experts (-1: skipped) and their weights; the lowest expert wins ties."""
    chosen = np.argsort(-logits, axis=1, kind="stable")[:, :top]
    kept = np.take_along_axis(logits, chosen, 1)
    w = np.exp(kept - kept[:, :1])
    w /= w.sum(axis=1, keepdims=True)
    if skip_beta > 0:
        keep = np.logical_and.accumulate(w >= skip_beta * w[:, :1], axis=1)
        w = np.where(keep, w, 0)
        w /= w.sum(axis=1, keepdims=True)
        chosen = np.where(keep, chosen, -1)
    return chosen, w.astype(np.float32)


class Transformer:
    def __init__(self, tensors: TensorFile, dims: Dims, skip_beta: float = 0.0, round_activations: bool = False) -> None:
        self.dims, self.skip_beta, self.rounding = dims, skip_beta, round_activations
        self.w = {name: tensors.get(name, kind, shape) for name, (kind, shape) in dims.shapes().items()}
        self._rope: tuple[np.ndarray, np.ndarray] = rope_tables(1, dims.head)

    def _get(self, name: str) -> np.ndarray:
        x = self.w[name]
        return widen(x) if x.dtype == np.uint16 else x

    def _in(self, x: np.ndarray) -> np.ndarray:
        """Input of a matrix product; rounded to bf16 on request."""
        return widen(narrow(x)) if self.rounding else x

    def _attention(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, starts: np.ndarray, ends: np.ndarray, sinks: np.ndarray) -> np.ndarray:
        dims, band = self.dims, self.dims.band
        group = dims.heads // dims.kv_heads
        out = np.empty_like(q)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            for lo in range(a, b, band):
                hi = min(lo + band, b)
                left, right = max(a, lo - band), min(b, hi + band)
                far = np.abs(np.arange(lo, hi)[:, None] - np.arange(left, right)) > band
                for h in range(dims.heads):
                    g = h // group
                    s = q[lo:hi, h] @ k[left:right, g].T
                    s[far] = -np.inf
                    top = np.maximum(s.max(axis=1, keepdims=True), sinks[h])
                    e = np.exp(s - top)
                    out[lo:hi, h] = (e @ v[left:right, g]) / (e.sum(axis=1, keepdims=True) + np.exp(sinks[h] - top))
        return out

    def _experts(self, x: np.ndarray, layer: str) -> np.ndarray:
        dims = self.dims
        chosen, weight = route(self._in(x) @ self._get(f"{layer}.mlp.gate.weight").T + self._get(f"{layer}.mlp.gate.bias"), dims.top, self.skip_beta)
        parts = np.zeros((len(x), dims.top, dims.d), np.float32)
        token, slot = np.nonzero(chosen >= 0)
        expert = chosen[token, slot]
        order = np.argsort(expert, kind="stable")  # each expert's tokens together: one product per expert
        edges = np.flatnonzero(np.diff(np.r_[-1, expert[order], dims.experts]))
        w1, b1, w2, b2 = (self.w[f"{layer}.mlp.{n}"] for n in ("swiglu.weight", "swiglu.bias", "out.weight", "out.bias"))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = order[lo:hi]
            e = int(expert[rows[0]])
            h = swiglu(self._in(x[token[rows]]) @ widen(w1[e]) + widen(b1[e])).astype(np.float32)
            parts[token[rows], slot[rows]] = (self._in(h) @ widen(w2[e]) + widen(b2[e])) * weight[token[rows], slot[rows]][:, None]
        return parts.sum(axis=1)

    def forward(self, ids: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Log probabilities (tokens x classes) of packed windows with the given lengths."""
        dims = self.dims
        if not len(ids):
            return np.zeros((0, dims.classes), np.float32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        pos = np.arange(len(ids)) - np.repeat(starts, lengths)
        if len(self._rope[0]) <= pos.max():
            self._rope = rope_tables(int(pos.max()) + 1, dims.head)
        cos, sin = self._rope[0][pos], self._rope[1][pos]
        scale = np.float32(dims.head**-0.25)
        x = widen(self.w["embedding.weight"][ids])
        for i in range(dims.layers):
            layer = f"block.{i}"
            t = self._in(rms_norm(x, self._get(f"{layer}.attn.norm.scale")))
            qkv = t @ self._get(f"{layer}.attn.qkv.weight").T + self._get(f"{layer}.attn.qkv.bias")
            q, k, v = (p.reshape(len(ids), -1, dims.head) for p in np.split(qkv, [dims.q, dims.q + dims.kv], axis=1))
            q, k = rotate(q, cos, sin) * scale, rotate(k, cos, sin) * scale
            o = self._attention(q, k, v, starts, ends, self._get(f"{layer}.attn.sinks") * np.float32(np.log(2.0)))
            x = x + self._in(o.reshape(len(ids), -1)) @ self._get(f"{layer}.attn.out.weight").T + self._get(f"{layer}.attn.out.bias")
            x = x + self._experts(rms_norm(x, self._get(f"{layer}.mlp.norm.scale")), layer)
        z = self._in(rms_norm(x, self._get("norm.scale"))) @ self._get("unembedding.weight").T
        z = z - z.max(axis=1, keepdims=True)
        return (z - np.log(np.exp(z).sum(axis=1, keepdims=True))).astype(np.float32)


class TransformerScorer:
    """Scores documents window by window, packed up to the token budget."""

    def __init__(self, path: str, dims: Dims, n_ctx: int, budget: int, skip_beta: float = 0.0, round_activations: bool = False) -> None:
        self.model = Transformer(TensorFile(path), dims, skip_beta, round_activations)
        self.n_ctx, self.budget, self.batches = n_ctx, budget, 0

    def __call__(self, texts: list[str], ids: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
        windows = cut(np.array([len(i) for i in ids], np.int64), self.n_ctx)
        out = []
        for group in pack([n for _, _, n in windows], self.budget):
            part = [windows[i] for i in group]
            self.batches += 1
            out.append(self.model.forward(np.concatenate([ids[d][o : o + n] for d, o, n in part]), [n for _, _, n in part]))
        return np.concatenate(out) if out else np.zeros((0, self.model.dims.classes), np.float32)


@lru_cache(maxsize=1)
def load_scorer(path: str, dims: Dims, n_ctx: int, budget: int, skip_beta: float) -> TransformerScorer:
    """One scorer per worker; the weights stay memory-mapped."""
    return TransformerScorer(path, dims, n_ctx, budget, skip_beta)
