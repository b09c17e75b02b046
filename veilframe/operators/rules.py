"""Rule scorer: regular expressions in place of a model, for data without weights.

It finds patterns only; names and addresses need a model.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import regex

from ..schema import CATEGORIES, N_LABELS, label_of
from .tokens import byte_offsets

RULES = {
    "private_email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "private_url": r"https?://[^\s<>\"]+[^\s<>\".,;:!?)]",
    "private_phone": r"(?<![\d.+])\+?\d{1,2} \(\d{3}\) \d{3}-\d{4}(?!\d)",
    "account_number": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])",
    "private_date": r"(?<!\d)\d{4}-(?:0\d|1[0-2])-(?:[0-2]\d|3[01])(?!\d)",
    "secret": r"(?<=(?i:token|secret|password|api_key)\s?[=:]\s?\"?)[A-Za-z0-9_\-]{16,}",
}
_COMPILED = [(CATEGORIES.index(c), regex.compile(p)) for c, p in RULES.items()]
_SURE = np.float32(np.log(0.96))
_REST = np.float32(np.log(0.04 / (N_LABELS - 1)))


def hits(text: str) -> list[tuple[int, int, int]]:
    """Matches as (category, start, end) in characters; an earlier rule wins where two overlap."""
    found: list[tuple[int, int, int]] = []  # by start; no two overlap
    for cat, pattern in _COMPILED:
        starts = [s for s, _, _ in found]
        new = []
        for m in pattern.finditer(text):
            a, b = m.span()
            i = bisect.bisect_left(starts, b)  # the last one that begins before the match ends
            if i == 0 or found[i - 1][1] <= a:
                new.append((a, b, cat))
        if new:
            found = sorted(found + new)
    return [(cat, a, b) for a, b, cat in found]


@lru_cache(maxsize=8)
def _compile(rules: tuple[tuple[str, str], ...]) -> list[tuple[int, regex.Pattern]]:
    return [(CATEGORIES.index(c), regex.compile(p)) for c, p in rules]


def hits_in_turn(text: str, rules: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int]]:
    """Matches as in ``hits``, of rules applied one after another: each to what the earlier ones left, ``<`` in place of the rest."""
    found: list[tuple[int, int, int]] = []
    for cat, pattern in _compile(rules):
        left, at = [], 0
        for m in pattern.finditer(text):
            a, b = m.span()
            found.append((cat, a, b))
            left += [text[at:a], "<" * (b - a)]
            at = b
        text = "".join([*left, text[at:]])
    return sorted(found, key=lambda h: h[1])


class RuleScorer:
    """Log probabilities that favour the labels of rule matches; a token belongs to a match if they share a byte."""

    needs_ids = False

    def __init__(self, rules: tuple[tuple[str, str], ...] | None = None) -> None:
        self.patterns = _COMPILED if rules is None else _compile(rules)
        self.hits = hits if rules is None else lambda text: hits_in_turn(text, rules)

    def silent(self, text: str) -> bool:
        """No rule matches anywhere in ``text``."""
        return not any(p.search(text) for _, p in self.patterns)

    def cuts(self, text: str) -> np.ndarray:
        """Bytes where a match begins or ends: a token that goes beyond is no part of what the rule says."""
        ends = np.array([x for _, a, b in self.hits(text) for x in (a, b)], np.int64)
        return ends if text.isascii() else byte_offsets(text)[ends]

    def __call__(self, texts: list[str], ids: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
        total = sum(map(len, ids))
        label = np.zeros(total, np.int64)
        base = 0
        for text, cut in zip(texts, bounds, strict=True):
            matches = self.hits(text)
            place = None if text.isascii() or not matches else byte_offsets(text)
            for cat, a, b in matches:
                start, end = (a, b) if place is None else (int(place[a]), int(place[b]))
                i = int(np.searchsorted(cut, start, side="right")) - 1
                j = int(np.searchsorted(cut, end, side="left")) - 1
                if i == j:
                    label[base + i] = label_of(cat, 3)
                else:
                    label[base + i : base + j + 1] = label_of(cat, 1)
                    label[base + i], label[base + j] = label_of(cat, 0), label_of(cat, 2)
            base += len(cut) - 1
        out = np.full((total, N_LABELS), _REST, np.float32)
        out[np.arange(total), label] = _SURE
        return out
