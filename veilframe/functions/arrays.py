"""Dense per-token arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column) -> Column:
    """Place of the largest value from 0, the lowest place on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    norm = top + F.ln(_sum(F.transform(a, lambda x: F.exp(x - top))))
    return F.transform(a, lambda x: x - norm)


def rms_norm(a: Column, eps: float = 1e-5, scale: Column | None = None) -> Column:
    """Each value over the root mean square; no mean is subtracted."""
    r = F.lit(1.0) / F.sqrt(_sum(F.transform(a, lambda x: x * x)) / F.size(a) + eps)
    out = F.transform(a, lambda x: x * r)
    return out if scale is None else F.zip_with(out, scale, lambda x, s: x * s)


def swiglu(a: Column, limit: float = 7.0, alpha: float = 1.702) -> Column:
    """Gated activation of an array whose first half is the gate and second half the linear part."""
    half = (F.size(a) / 2).cast("int")
    gate, lin = F.slice(a, 1, half), F.slice(a, half + 1, half)

    def one(g: Column, x: Column) -> Column:
        g = F.least(g, F.lit(limit))
        return g / (1.0 + F.exp(-alpha * g)) * (F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)) + 1.0)

    return F.zip_with(gate, lin, one)


def top_experts(logits: Column, k: int = 4, skip_beta: float = 0.0) -> Column:
    """Router: array of (expert, gate) for the k largest logits, lowest expert on ties, softmax over those kept.

    With ``skip_beta``, slots from the first gate under ``skip_beta`` times the top one are dropped and the rest rescaled.
    """
    ranked = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("less"), i.alias("expert"))))
    kept = F.slice(ranked, 1, k)
    top = F.get(kept, F.lit(0))["less"]
    weight = F.transform(kept, lambda s: F.exp(top - s["less"]))
    if skip_beta > 0:  # weights fall, so the slots at or over the threshold are a prefix
        keep = F.size(F.filter(weight, lambda w: w >= skip_beta * F.get(weight, F.lit(0))))
        kept, weight = F.slice(kept, 1, keep), F.slice(weight, 1, keep)
    total = _sum(weight)
    return F.zip_with(kept, weight, lambda s, w: F.struct(s["expert"].alias("expert"), (w / total).alias("gate")))


def rotate_pairs(a: Column, cos: Column, sin: Column) -> Column:
    """Rotary embedding of interleaved pairs (2i, 2i + 1)."""
    return F.transform(
        a,
        lambda x, j: F.when(j % 2 == 0, x * F.get(cos, (j / 2).cast("int")) - F.get(a, j + 1) * F.get(sin, (j / 2).cast("int"))).otherwise(
            x * F.get(cos, ((j - 1) / 2).cast("int")) + F.get(a, j - 1) * F.get(sin, ((j - 1) / 2).cast("int"))
        ),
    )
