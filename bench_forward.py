"""Throughput of the transformer at full width with random weights, one layer of the model.

The full model has eight such layers; its tokens a second are projected as tokens / (8 * layer time), embedding and
head being small.  Runs one process per core, as Spark tasks do.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import multiprocessing
import tempfile
import time

import numpy as np

from veilframe.operators.transformer import Dims, Transformer
from veilframe.sources.tensors import TensorFile, narrow, write_tensors

CORES = int(os.environ.get("BENCH_CPUS", "8"))
TOKENS = int(os.environ.get("BENCH_TOKENS", "4096"))
DIMS = Dims(layers=1, vocab=2048)
FULL_LAYERS = Dims().layers


def weights(path: str) -> None:
    rng = np.random.default_rng(1)
    out = {}
    for name, (kind, shape) in DIMS.shapes().items():
        x = rng.standard_normal(shape, np.float32) * np.float32(0.5 if len(shape) == 1 else shape[-1] ** -0.5)
        out[name] = narrow(x) if kind == "BF16" else x
    write_tensors(path, out)


def run(path: str) -> float:
    model = Transformer(TensorFile(path), DIMS)
    ids = np.random.default_rng(2).integers(0, DIMS.vocab, TOKENS)
    model.forward(ids[:512], [512])
    began = time.time()
    model.forward(ids, [TOKENS])
    return time.time() - began


def measure() -> dict[str, object]:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "model.safetensors")
        weights(path)
        with multiprocessing.Pool(CORES) as pool:
            seconds = pool.map(run, [path] * CORES, chunksize=1)
    layer = sum(TOKENS / s for s in seconds)
    return {"metric": "projected forward throughput, full width and eight layers", "value": round(layer / FULL_LAYERS, 1), "unit": "tokens/sec", "cores": CORES, "one_layer_tokens_per_sec": round(layer, 1)}


if __name__ == "__main__":
    print(json.dumps(measure()))
