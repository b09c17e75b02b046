"""A trained model's folder: ``model.safetensors`` and a rank file (``*.tiktoken``).

Weights are checked on the driver before a run and sent once to every executor as a file of the application, where
workers map them into memory; where executors see the given path themselves, they map that.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from ..config import Config
from ..operators.detect import rule_scorer
from ..operators.transformer import dims_of, load_scorer
from .tensors import TensorFile

WEIGHTS = "model.safetensors"
_shared: set[tuple[str, str]] = set()


def weights_of(model: str) -> str:
    return os.path.join(model, WEIGHTS) if os.path.isdir(model) else model


def vocabulary_of(config: Config) -> str | None:
    """The rank file of a run; a model needs one, its own folder's unless another is named."""
    if config.vocabulary or not config.model:
        return config.vocabulary
    found = sorted(glob.glob(os.path.join(glob.escape(config.model), "*.tiktoken")))
    if len(found) != 1:
        raise ValueError(f"{config.model}: one rank file is needed, {len(found)} found")
    return found[0]


def share_weights(spark: SparkSession, model: str) -> None:
    """Check names, types and shapes of all tensors, and send the file to the executors, once per application."""
    path = weights_of(model)
    tensors = TensorFile(path)
    for name, (kind, shape) in dims_of(tensors).shapes().items():
        tensors.get(name, kind, shape)
    key = spark.sparkContext.applicationId, os.path.abspath(path)
    if key not in _shared and spark.sparkContext.master.split("[")[0] != "local":
        spark.sparkContext.addFile(path)
    _shared.add(key)


def model_scorer(config: Config):
    """The scorer of ``config.model`` in a worker, made once."""
    path = weights_of(config.model)
    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path) if path.endswith(".safetensors") else WEIGHTS)
    return load_scorer(path, dims_of(TensorFile(path)), config.n_ctx, config.budget, config.skip_beta)


def scorer_of(config: Config) -> Callable:
    return model_scorer if config.model else rule_scorer
