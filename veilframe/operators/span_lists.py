"""Selection and masking of span lists inside a Python stage; the same results as the column functions."""

from __future__ import annotations

from collections.abc import Iterable


def _sweep(spans: Iterable[dict]) -> list[dict]:
    kept, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["label"])):
        if at <= s["start"] < s["end"]:
            kept.append(s)
            at = s["end"]
    return kept


def select(spans: list[dict], cap: int | None = None) -> list[dict]:
    """Non-overlapping spans, first inside each label, then over all."""
    by: dict[str, list[dict]] = {}
    for s in spans:
        by.setdefault(s["label"], []).append(s)
    return _sweep(s for label in sorted(by) for s in _sweep(by[label][:cap]))


def mask(text: str, spans: list[dict]) -> str:
    return mask_bytes(text.encode("utf-8", "surrogatepass"), spans).decode("utf-8", "surrogatepass")


def mask_bytes(raw: bytes, spans: list[dict]) -> bytes:
    """``raw`` with each of sorted, non-overlapping spans replaced by its placeholder."""
    out, pos = [], 0
    for s in spans:
        out += [raw[pos : s["start"]], f"<{s['label'].upper()}>".encode()]
        pos = s["end"]
    return b"".join([*out, raw[pos:]])
