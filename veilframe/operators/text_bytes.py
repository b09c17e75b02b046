"""Byte ranges inside UTF-8 text: snapping to characters and trimming white space."""

from __future__ import annotations

import numpy as np

# White_Space characters and the separators U+001C to U+001F.
TRIM_CHARS = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_TRIM = "".join(sorted(TRIM_CHARS))


def _continues(data: bytes, at: int) -> bool:
    return data[at] & 0xC0 == 0x80


def snap(data: bytes, start: int, end: int) -> tuple[int, int]:
    """Widen a range until it cuts no character."""
    while start > 0 and _continues(data, start):
        start -= 1
    while end < len(data) and _continues(data, end):
        end += 1
    return start, end


def trim(data: bytes, start: int, end: int) -> tuple[int, int]:
    """Narrow a range by the white space at its ends."""
    piece = data[start:end].decode("utf-8", "surrogateescape")
    left = piece.lstrip(_TRIM)
    start += len(piece[: len(piece) - len(left)].encode("utf-8", "surrogateescape"))
    return start, start + len(left.rstrip(_TRIM).encode("utf-8", "surrogateescape"))


def _lossy(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Characters of possibly invalid UTF-8, the size of each in ``data`` and whether it stands for a byte that starts no valid sequence."""
    cp = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = (cp >= 0xDC80) & (cp <= 0xDCFF)  # surrogates in UTF-8 are no valid sequences, so there are no others
    size = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    size[raw] = 1
    return np.where(raw, np.uint32(0xFFFD), cp).tobytes().decode("utf-32-le"), size, raw


def decode_lossy(data: bytes) -> tuple[str, list[int]]:
    """Characters of possibly invalid UTF-8 and the byte offset of each; a byte that starts no valid sequence becomes U+FFFD."""
    text, size, _ = _lossy(data)
    return text, (np.cumsum(size, dtype=np.int64) - size).tolist()


def readable(data: bytes) -> tuple[str, np.ndarray | None]:
    """The text that is scored, and where each byte of it (and its end) stands in ``data``; None: in the same place."""
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        text, size, raw = _lossy(data)
    broken = np.cumsum(size, dtype=np.int64)[raw] - 1
    broken += 2 * np.arange(len(broken))  # U+FFFD takes three bytes, which all stand in the place of one
    step = np.ones(len(data) + 2 * len(broken) + 1, np.int64)
    step[0] = step[broken + 1] = step[broken + 2] = 0
    return text, np.cumsum(step)
