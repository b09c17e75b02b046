"""Tokens with byte ranges: rank-file BPE, or pretokens that stand in for tokens."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pretokens import SPECIALS, find_pretokens
from ..functions.unicode_classes import SPACE, python_pattern
from .text_bytes import readable

#: Runs of white space without line ends from this many characters on are cut out before matching; the library's matcher gives up at a million.
LONG_RUN = 100_000


def parse_ranks(lines: list[tuple[str, int]]) -> dict[bytes, int]:
    return {base64.b64decode(token): rank for token, rank in lines}


class Tokenizer:
    """Token ids and byte ranges of a text.

    Special literals become their own tokens if ``specials``; the text before one is split as if it ended there.
    Without ranks every pretoken is a token, its id a stable 31-bit hash.
    """

    def __init__(self, ranks: dict[bytes, int] | None, specials: bool = True) -> None:
        self.specials = specials
        self.sizes: np.ndarray | None = None
        self.encoding = None
        if ranks is not None:
            import tiktoken

            self.encoding = tiktoken.Encoding("ranks", pat_str=python_pattern(), mergeable_ranks=ranks, special_tokens=SPECIALS)
            self.sizes = np.zeros(max(max(ranks.values()), *SPECIALS.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = [len(t) for t in ranks]
            for literal, i in SPECIALS.items():
                self.sizes[i] = len(literal)

    def encode(self, text: str, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids (zeros if they are not wanted and cost extra), and token boundaries in bytes (one more than ids)."""
        if self.encoding is not None:
            ids = np.concatenate([self._ids(text[a:b], whole) for a, b, whole in self._parts(text)]).astype(np.int64)
            sizes = self.sizes[ids]
        else:
            pieces = self._pieces(text)
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            if with_ids:
                ids = np.array([SPECIALS[p] if self.specials and p in SPECIALS else _stable(p.encode("utf-8", "surrogatepass")) for p in pieces], np.int64)
            else:
                ids = np.zeros(len(pieces), np.int64)
            return ids, np.r_[0, ends if text.isascii() else byte_offsets(text)[ends]]
        return ids, np.r_[0, np.cumsum(sizes)]

    def _ids(self, text: str, whole: bool) -> np.ndarray:
        """Ids of a part of a text; ``whole``: it is one pretoken."""
        if whole:
            return np.array(self.encoding._encode_single_piece(text), np.uint32)
        allowed = "all" if self.specials else frozenset()
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except UnicodeEncodeError:  # lone surrogates count as U+FFFD
            return self.encoding.encode_to_numpy(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), allowed_special=allowed, disallowed_special=())

    def _parts(self, text: str) -> list[tuple[int, int, bool]]:
        """Parts of a text (start, end, whether it is one pretoken) that can be encoded one by one.

        A run of white space behind its last line end begins a pretoken, which ends with the text or a special literal,
        or else before the run's last character.
        """
        out, at = [], 0
        if len(text) >= LONG_RUN:
            for run in _runs().finditer(text):
                start, end = run.span()
                if end - start >= LONG_RUN and text[end : end + 1] not in ("\r", "\n"):
                    end -= not (end == len(text) or self.specials and text.startswith(tuple(SPECIALS), end))
                    out += [(at, start, False), (start, end, True)]
                    at = end
        return [*out, (at, len(text), False)]

    def _pieces(self, text: str) -> list[str]:
        if not self.specials or "<|endof" not in text:
            return find_pretokens(text)
        import regex

        out: list[str] = []
        for part in regex.split("(" + "|".join(map(regex.escape, SPECIALS)) + ")", text):
            out += [part] if part in SPECIALS else find_pretokens(part)
        return out


@lru_cache(maxsize=1)
def _runs():
    import regex

    return regex.compile(rf"(?V1)[[{SPACE}]--[\r\n]]{{2,}}+".replace(r"\x{85}", r"\x85"))


def byte_offsets(text: str) -> np.ndarray:
    """Byte offset of every character and of the end."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.r_[0, np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))]


def _stable(raw: bytes) -> int:
    import zlib

    return zlib.crc32(raw) & 0x7FFFFFFF


@lru_cache(maxsize=2)
def _tokenizer(key: tuple | None, specials: bool) -> Tokenizer:
    return Tokenizer(dict(key) if key is not None else None, specials)


_by_broadcast: dict[int, Tokenizer] = {}


def tokenizer(ranks, specials: bool) -> Tokenizer:
    """The worker's tokenizer for a broadcast of ranks (None: pretokens)."""
    if ranks is None:
        return _tokenizer(None, specials)
    value = ranks.value
    key = id(value) * 2 + specials
    if key not in _by_broadcast:
        _by_broadcast.clear()
        _by_broadcast[key] = Tokenizer(value, specials)
    return _by_broadcast[key]


def _on_bytes(tok: Tokenizer, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a text as stored, boundaries in its own bytes."""
    text, place = readable(data)
    ids, bounds = tok.encode(text)
    return ids, bounds if place is None else place[bounds]


def _starts(ids: list[np.ndarray]) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32))


def _joined(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(np.int32, copy=False) if parts else np.zeros(0, np.int32))


def _tokenize(it: Iterator[pa.RecordBatch], ranks, specials: bool) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(ranks, specials)
    for batch in it:
        ids, bounds = zip(*[_on_bytes(tok, t or b"") for t in batch.column(1).to_pylist()], strict=True) if batch.num_rows else ((), ())
        toks = pa.StructArray.from_arrays([_joined(ids), _joined([b[:-1] for b in bounds]), _joined([b[1:] for b in bounds])], ["id", "bs", "be"])
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(_starts(ids), toks)], ["doc_id", "toks"])


def _only_ids(it: Iterator[pa.RecordBatch], ranks, specials: bool) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(ranks, specials)
    for batch in it:
        ids, ends = [], []
        for t in batch.column(1).to_pylist():
            found, bounds = _on_bytes(tok, t or b"")
            ids.append(found.astype(np.int32))
            ends.append(int(bounds[-1]))
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(_starts(ids), _joined(ids)), pa.array(ends, pa.int32())], ["doc_id", "ids", "n_bytes"])


def _in_arrow(docs: DataFrame, stage: Callable, ranks: dict[bytes, int] | None, specials: bool, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(ranks) if ranks is not None else None
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: stage(it, sent, specials), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def bpe_tokens(docs: DataFrame, ranks: dict[bytes, int] | None, specials: bool = True) -> DataFrame:
    """doc_id, toks: the tokens of each text with byte ranges; null counts as empty."""
    return _in_arrow(docs, _tokenize, ranks, specials, "toks array<struct<id:int,bs:int,be:int>>")


def bpe_ids(docs: DataFrame, ranks: dict[bytes, int] | None, specials: bool = True) -> DataFrame:
    """doc_id, ids, n_bytes: the tokens of each text without ranges, a tenth of their memory in a row, and the bytes they cover."""
    return _in_arrow(docs, _only_ids, ranks, specials, "ids array<int>, n_bytes int")
