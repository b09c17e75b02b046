"""Vectorised word hashing over Arrow string columns.

All word-based operators that run in Python share this module.  A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D, so UTF-8 text never has to be decoded: the Arrow value
buffer is read as bytes and hashed with numpy, about ten array passes per byte and none per
word.  Texts are cut into pieces of at most ``PIECE`` bytes at word boundaries, so the
temporaries stay small however long one document is.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
U64 = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); bijective, returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


_BASE = 0xD1342543DE82EF95
_TABLES: dict[tuple[int, bool], np.ndarray] = {}
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for b in (_BASE, _inverse(_BASE)):
            p = np.full(PIECE + 1, b, dtype=U64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS


def _byte_table(seed: int, lower: bool) -> np.ndarray:
    key = (seed, lower)
    if key not in _TABLES:
        t = mix64(odd_constants(256, 77 + seed))
        if lower:
            t = t[_ASCII_LOWER]
        t[_SPACE] = 0
        _TABLES[key] = t
    return _TABLES[key]


def _two_byte_lower() -> np.ndarray:
    out = np.arange(0x800)
    for cp in range(0x80, 0x800):
        low = chr(cp).lower()
        if len(low) == 1 and 0x80 <= ord(low) < 0x800:
            out[cp] = ord(low)
    return out


_LOWER2 = _two_byte_lower()


def lower_case(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII letters and letters of two bytes (Latin, Greek, Cyrillic) in lower case."""
    out = _ASCII_LOWER[data]
    at = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF))
    if len(at):
        cp = _LOWER2[((data[at].astype(np.int64) & 0x1F) << 6) | (data[at + 1] & 0x3F)]
        out[at] = 0xC0 | (cp >> 6)
        out[at + 1] = 0x80 | (cp & 0x3F)
    return out


class Words(NamedTuple):
    """Words of some documents: ``hash``, byte range in ``data``, and ``first[d]:first[d+1]`` per document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(len(column) + 1, kind)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw, offs.astype(np.int64)


def _pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Cut ``lo:hi`` after white space into ranges of at most PIECE bytes (longer only inside one huge word)."""
    while hi - lo > PIECE:
        cut = lo + PIECE
        space = np.flatnonzero(_SPACE[data[lo:cut]])
        if len(space):
            cut = lo + int(space[-1]) + 1
        else:
            cut = hi
            for at in range(lo + PIECE, hi, PIECE):
                more = np.flatnonzero(_SPACE[data[at : min(at + PIECE, hi)]])
                if len(more):
                    cut = at + int(more[0]) + 1
                    break
        yield lo, cut
        lo = cut
    yield lo, hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 0) -> Words:
    """Words of the documents ``offsets[i]:offsets[i+1]`` of ``data`` with a 64-bit hash each."""
    table = _byte_table(seed, lower)
    pow_, inv = _powers()
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    lo, top = int(offsets[0]), int(offsets[-1])
    for a, b in _pieces(data, lo, top) if top > lo else ():
        part = data[a:b]
        n = b - a
        is_word = ~_SPACE[part]
        edge = np.empty(n, dtype=bool)
        edge[0] = True
        np.logical_not(is_word[:-1], out=edge[1:])
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        edge[inner] = True
        s = np.flatnonzero(edge & is_word)
        if not len(s):
            continue
        stop = np.empty(n, dtype=bool)
        stop[-1] = True
        np.logical_not(is_word[1:], out=stop[:-1])
        stop[inner[inner > 0] - 1] = True
        e = np.flatnonzero(stop & is_word) + 1
        value = table[part]
        if n <= PIECE:
            value *= pow_[:n]
            h = np.add.reduceat(value, s)
            h *= inv[s]
        else:  # one word longer than a piece
            at = np.arange(n, dtype=np.int64)
            base = np.full(n, _BASE, dtype=U64)
            base[0] = 1
            value *= np.cumprod(base)
            h = np.add.reduceat(value, s)
            back = np.full(n, _inverse(_BASE), dtype=U64)
            back[0] = 1
            h *= np.cumprod(back)[at[s]]
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix64(h))
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start = cat(starts, np.int64)
    return Words(data, start, cat(ends, np.int64), cat(hashes, U64), np.searchsorted(start, offsets).astype(np.int64))


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the ``k`` consecutive words that begin at each position (shorter by k-1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = odd_constants(k, 1000 + seed)
    out = h[:n] * c[0]
    for j in range(1, k):
        out += h[j : j + n] * c[j]
    return mix64(out)


def release() -> None:
    """Give freed memory back: workers live on between tasks, beside others on the same machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def batches(it: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut into runs of rows with about ``most`` bytes of text (one row at least)."""
    for batch in it:
        if not batch.num_rows:
            continue
        data, offs = string_buffers(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), data, offs[lo : hi + 1]
            lo = hi
    release()


def as_text(values: list[bytes]) -> pa.Array:
    """Byte strings as a string column; bytes that are not UTF-8 stay as they are, as they do in Spark."""
    raw = pa.array(values, pa.binary())
    return pc.cast(raw, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)
