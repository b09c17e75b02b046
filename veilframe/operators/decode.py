"""Label decoding: constrained Viterbi over many documents at once, arg-max, and spans of label runs.

The constraint of begin/inside/end/single tags has two parts: outside, end and single are followed by outside, begin
or single; begin and inside by inside or end of the same category.  One step therefore needs one
maximum over 17 closed states, shared by all openings, and one of two per category.  Documents advance together,
longest first, so a step is a few array operations for all documents that are still running.
"""

from __future__ import annotations

import numpy as np

from ..schema import CATEGORIES, FORBIDDEN, N_LABELS

_K = len(CATEGORIES)
_B, _I, _E, _S = (np.arange(_K) * 4 + t for t in (1, 2, 3, 4))
_CLOSED = np.sort(np.r_[0, _E, _S])
_OPENING = np.sort(np.r_[0, _B, _S])
_WALL = np.float32(FORBIDDEN)


def viterbi(lp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Best labels of the documents ``lp[offsets[i]:offsets[i+1]]`` (rows of 33 log probabilities).

    Sums are 32-bit floats in token order; of equal paths the one with the lowest label id wins at each step.
    Where the best labels of the single tokens make a well-formed path, that path is best and nothing is searched: rounding
    keeps order, so no sum can pass it; it wins ties where it says outside, the lowest label, and elsewhere it must lead
    by more than rounding can take away.
    """
    lp = np.asarray(lp, np.float32)
    size = np.diff(offsets)
    out = np.zeros(int(offsets[-1] - offsets[0]), np.uint8)
    plain = _agreed(lp, offsets - offsets[0], out)
    order = np.argsort(-size, kind="stable")
    order = order[(size[order] > 0) & ~plain[order]]
    if not len(order):
        return out
    first = offsets[:-1][order] - offsets[0]
    length = size[order]
    state = lp[first].copy()
    state[:, np.r_[_I, _E]] += _WALL
    closed_from = np.zeros(len(out), np.uint8)  # predecessor of all openings
    inner_from = np.zeros((len(out), _K), bool)  # predecessor of inside and end: inside (else begin)
    alive = len(order)
    final = np.zeros(len(order), np.uint8)

    def close(lo: int, hi: int) -> None:
        ends = state[lo:hi].copy()
        ends[:, np.r_[_B, _I]] += _WALL
        final[lo:hi] = np.argmax(ends, axis=1)

    for t in range(1, int(length[0]) + 1):
        still = int(np.searchsorted(-length, -t, side="left"))  # documents with more than t tokens
        if still < alive:
            close(still, alive)
            alive = still
        if not alive:
            break
        now = state[:alive]
        at = first[:alive] + t
        best = _CLOSED[np.argmax(now[:, _CLOSED], axis=1)]
        top = now[np.arange(alive), best]
        inside = now[:, _I] > now[:, _B]
        run = np.where(inside, now[:, _I], now[:, _B])
        closed_from[at] = best
        inner_from[at] = inside
        new = lp[at].copy()
        new[:, _OPENING] += top[:, None]
        new[:, _I] += run
        new[:, _E] += run
        state[:alive] = new
    label = final.copy()
    last = first + length - 1
    out[last] = label
    for t in range(int(length[0]) - 1, 0, -1):
        n = int(np.searchsorted(-length, -t, side="left"))
        at = first[:n] + t
        now = out[at]
        tag = (now.astype(np.int16) - 1) % 4
        cat = np.maximum(now.astype(np.int16) - 1, 0) // 4
        inner = (now > 0) & ((tag == 1) | (tag == 2))
        back = np.where(inner_from[at, cat], _I[cat], _B[cat])
        out[at - 1] = np.where(inner, back, closed_from[at])
    return out


_ULPS = 64  # sums of two paths with one difference keep it but for a step of the grid where they pass a power of two


def _agreed(lp: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Documents whose best labels token by token are the best path; those are put in ``out``."""
    n = len(offsets) - 1
    good = np.ones(n, bool)
    if not len(lp):
        return good
    best = np.argmax(lp, axis=1)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    some = np.diff(offsets) > 0
    head, last = offsets[:-1][some], offsets[1:][some] - 1
    tag = np.where(best > 0, (best - 1) % 4, 4)
    good[doc[head[(tag[head] == 1) | (tag[head] == 2)]]] = False
    good[doc[last[tag[last] <= 1]]] = False
    follows = np.ones(len(best), bool)
    follows[1:] = _MAY_FOLLOW[best[:-1], best[1:]]
    follows[head] = True
    good[doc[~follows]] = False
    hit = np.flatnonzero(best > 0)
    top = np.partition(lp[hit], N_LABELS - 2, axis=1)[:, -2:]
    size = np.r_[0.0, np.cumsum(np.abs(lp[np.arange(len(lp)), best], dtype=np.float64))]
    reach = size[offsets[1:]] - size[offsets[:-1]]
    good[doc[hit[top[:, 1] - top[:, 0] <= _ULPS * np.finfo(np.float32).eps * reach[doc[hit]]]]] = False
    use = good[doc]
    out[use] = best[use]
    return good


def argmax_labels(lp: np.ndarray) -> np.ndarray:
    """Best label of each token by itself, the lowest on ties; sequences may be malformed."""
    return np.argmax(np.asarray(lp, np.float32), axis=1).astype(np.uint8) if len(lp) else np.zeros(0, np.uint8)


def label_runs(labels: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of labels as (category, first token, last token).

    A labelled token opens a run if it is tagged begin or single, or follows anything but begin or inside of its own
    category; a run lasts until the next opening, outside token or end of the document.
    """
    labels = labels.astype(np.int16)
    n = len(labels)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cat, tag, hit = (labels - 1) // 4, (labels - 1) % 4, labels > 0
    head = np.zeros(n, bool)
    head[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True
    goes_on = np.zeros(n, bool)
    goes_on[1:] = hit[:-1] & (tag[:-1] <= 1) & (cat[:-1] == cat[1:])
    opens = hit & ((tag == 0) | (tag == 3) | ~goes_on | head)
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(opens | ~hit | head)
    following = np.searchsorted(stops, starts, side="right")
    ends = np.where(following < len(stops), stops[np.minimum(following, len(stops) - 1)], n) - 1
    return cat[starts].astype(np.int64), starts, ends


def transition_matrix() -> np.ndarray:
    """0 where a label may follow another, FORBIDDEN elsewhere (rows: previous)."""
    m = np.full((N_LABELS, N_LABELS), FORBIDDEN, np.float32)
    m[np.ix_(_CLOSED, _OPENING)] = 0
    for k in range(_K):
        m[np.ix_([_B[k], _I[k]], [_I[k], _E[k]])] = 0
    return m


_MAY_FOLLOW = transition_matrix() == 0
