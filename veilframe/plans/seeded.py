"""Seeded weights for checks without a checkpoint."""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

import numpy as np

from ..config import Config
from ..operators.transformer import Dims, TransformerScorer
from ..sources.tensors import narrow, write_tensors


def seeded_tensors(dims: Dims, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for name, (kind, shape) in dims.shapes().items():
        x = (rng.standard_normal(shape) * (0.5 if len(shape) == 1 else shape[-1] ** -0.5)).astype(np.float32)
        if name.endswith("scale"):
            x = 1 + 0.1 * x
        out[name] = narrow(x) if kind == "BF16" else x
    return out


@lru_cache(maxsize=4)
def _file(dims: Dims, seed: int) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="veilframe-"), "model.safetensors")
    write_tensors(path, seeded_tensors(dims, seed))
    return path


class _Scorer:
    """Every worker writes the same small file for itself; ids are folded into the small vocabulary."""

    def __init__(self, dims: Dims, seed: int, config: Config) -> None:
        self.inner = TransformerScorer(_file(dims, seed), dims, config.n_ctx, config.budget, config.skip_beta)

    def __call__(self, texts, ids, bounds):
        return self.inner(texts, [i % self.inner.model.dims.vocab for i in ids], bounds)


def seeded_scorer(dims: Dims, seed: int):
    return lambda config: _Scorer(dims, seed, config)
