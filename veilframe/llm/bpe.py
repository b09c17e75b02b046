"""Byte-level BPE over a pair occurrence index.

All new pretokens of a batch are laid out as one array of byte symbols, linked inside each pretoken.  An
index maps every adjacent pair that has a rank to all its positions.  The active ranks are taken in
ascending order from a heap; one step merges every listed position of that pair, and only the pairs to
its left and right enter the index anew.  Symbols, links and positions take 32 bits each, so one word of many megabytes
needs about 40 bytes of memory a byte.  In a vocabulary whose merged token never has a lower rank
than the merges that build it (checked on loading), this equals merging each pretoken by itself.

Pretokens repeat, so their ids are kept in a table per worker.  When it is full it becomes the old table and a new one
starts; what is met again moves over, so frequent pretokens stay.  That changes speed only.  There is no
shuffle.  Texts are handled whole.

The vocabulary is a file of the ``tokenizers`` JSON format; its path is a parameter.  It is sent to
the tasks as a broadcast of the file's content, whose size is fixed by the vocabulary.

Edge cases: null text counts as empty and has no tokens; special tokens of the file that occur in a text
become their own ids; bytes that are not UTF-8 decode to U+FFFD as usual; ids may repeat; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import batches, string_buffers

# The pretoken pattern of byte-level BPE and the White_Space characters.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BEYOND_LATIN = regex.compile(r"[^\x00-\u024f]")

TABLE = 150_000
STRETCH = 1 << 20  # places that numpy handles at a time
MANY = 200  # places of one pair from which they are merged together


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Symbols:
    """Linked symbols of some pretokens and the index of their active pairs, 32 bits a place.

    ``sym`` is -1 where a symbol was merged into one before it; ``nxt`` and ``prv`` are -1 at the ends of a pretoken.
    """

    def __init__(self, vocab: Vocabulary, raw: np.ndarray, first: np.ndarray) -> None:
        n = len(raw)
        self.vocab = vocab
        links = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        links[0][first[1:] - 1] = -1
        links[1][first[:-1]] = -1
        self.sym, self.nxt, self.prv = (array("i", x.tobytes()) for x in (vocab.byte_id[raw], *links))
        self.sym_view, self.nxt_view, self.prv_view = (np.frombuffer(x, np.int32) for x in (self.sym, self.nxt, self.prv))
        self.at: dict[int, array] = {}
        for lo in range(0, n - 1, STRETCH):
            hi = min(lo + STRETCH, n - 1)
            rank = vocab.byte_rank[raw[lo:hi], raw[lo + 1 : hi + 1]]
            place = np.flatnonzero((rank >= 0) & (self.nxt_view[lo:hi] >= 0))
            self._enter(rank[place], place + lo)
        self.heap = list(self.at)
        heapq.heapify(self.heap)

    def _enter(self, rank: np.ndarray, place: np.ndarray) -> list[int]:
        """Add places to the index by rank; returns the ranks that it did not have."""
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order].astype(np.int32)
        new: list[int] = []
        if not len(rank):
            return new
        cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        for r, a, b in zip(rank[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(rank)], strict=True):
            if r not in self.at:
                self.at[r] = array("i")
                new.append(r)
            self.at[r].frombytes(place[a:b].tobytes())
        return new

    def merge(self) -> None:
        """Merge pairs by ascending rank until none is active."""
        while self.heap:
            r = heapq.heappop(self.heap)
            places = self.at.pop(r)
            x, y, z = self.vocab.merged[r]
            if x != y and len(places) > MANY:  # places of such a pair cannot overlap
                self._merge_many(np.unique(np.frombuffer(places, np.int32)), x, y, z)
            else:
                self._merge_few(places, x, y, z)

    def _merge_many(self, i: np.ndarray, x: int, y: int, z: int) -> None:
        sym, nxt, prv, vocab = self.sym_view, self.nxt_view, self.prv_view, self.vocab
        for lo in range(0, len(i), STRETCH):
            a = i[lo : lo + STRETCH]
            j = nxt[a]
            ok = (sym[a] == x) & (j >= 0)
            a, j = a[ok], j[ok]
            ok = sym[j] == y
            a, j = a[ok], j[ok]
            sym[a], sym[j] = z, -1
            k = nxt[j]
            nxt[a] = k
            prv[k[k >= 0]] = a[k >= 0]
        for lo in range(0, len(i), STRETCH):
            a = i[lo : lo + STRETCH]
            a = a[sym[a] == z]
            for side, right in ((nxt[a], True), (prv[a], False)):
                here = np.flatnonzero(side >= 0)
                other, back = np.unique(sym[side[here]], return_inverse=True)
                ranks = np.array([vocab.pair.get((z, o) if right else (o, z), -1) for o in other.tolist()], np.int64)[back] if len(here) else np.zeros(0, np.int64)
                hit = ranks >= 0
                for s in self._enter(ranks[hit], (a if right else side)[here][hit]):
                    heapq.heappush(self.heap, s)

    def _merge_few(self, places: array, x: int, y: int, z: int) -> None:
        sym, nxt, prv, at, heap, rank_of = self.sym, self.nxt, self.prv, self.at, self.heap, self.vocab.pair.get
        if len(places) > MANY:
            places = array("i", np.sort(np.frombuffer(places, np.int32)).tobytes())
        else:
            places = sorted(places)
        for i in places:
            j = nxt[i]
            if sym[i] != x or j == -1 or sym[j] != y:
                continue
            sym[i] = z
            sym[j] = -1
            k = nxt[j]
            nxt[i] = k
            h = prv[i]
            if k != -1:
                prv[k] = i
                s = rank_of((z, sym[k]))
                if s is not None:
                    if s in at:
                        at[s].append(i)
                    else:
                        at[s] = array("i", (i,))
                        heapq.heappush(heap, s)
            if h != -1:
                s = rank_of((sym[h], z))
                if s is not None:
                    if s in at:
                        at[s].append(h)
                    else:
                        at[s] = array("i", (h,))
                        heapq.heappush(heap, s)


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        symbols = byte_symbols()
        of = {c: b for b, c in enumerate(symbols)}
        ids = spec["model"]["vocab"]
        self.byte_id = np.array([ids[c] for c in symbols], np.int32)
        self.pair: dict[tuple[int, int], int] = {}
        self.merged: list[tuple[int, int, int]] = []
        born: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            if max(born.get(x, -1), born.get(y, -1)) >= rank:
                raise ValueError("a merge precedes the merges that build it")
            born.setdefault(z, rank)
            self.pair[x, y] = rank
            self.merged.append((x, y, z))
        self.byte_rank = np.array([[self.pair.get((x, y), -1) for y in self.byte_id.tolist()] for x in self.byte_id.tolist()], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        table = {i: bytes(of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.offset = np.r_[0, np.cumsum(self.length)][:-1]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pretokens: Iterable[str]) -> None:
        """Encode pretokens that the table lacks, all of them in one index."""
        table, old = self.table, self.old
        new = [p for p in pretokens if p not in table]
        if len(table) + len(new) > TABLE:
            self.old, self.table = old, table = table, {}
            new = list(pretokens)
        if old:
            met = [p for p in new if p in old]
            table.update((p, old[p]) for p in met)
            new = [p for p in new if p not in table]
        if not new:
            return
        raw = np.frombuffer(b"".join(p.encode("utf-8", "surrogatepass") for p in new), np.uint8)
        first = np.r_[0, np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in new])]
        symbols = _Symbols(self, raw, first)
        symbols.merge()
        ids = symbols.sym_view
        live = ids >= 0
        cut = np.r_[0, np.cumsum(live)][first] * 4
        packed = ids[live].astype("<u4").tobytes()
        table.update((p, packed[a:b]) for p, a, b in zip(new, cut[:-1].tolist(), cut[1:].tolist(), strict=True))

    def pretokens(self, text: str) -> list[str]:
        if _BEYOND_LATIN.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return _library_pretokens(text)
        return PRETOKEN.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[list[str] | bytes]] = []
        seen: set[str] = set()
        for t in texts:
            own: list[list[str] | bytes] = []
            for i, piece in enumerate(self.split.split(t) if self.split else [t]):
                if i % 2:
                    own.append(self.special[piece].to_bytes(4, "little"))
                elif piece:
                    own.append(p := self.pretokens(piece))
                    seen.update(p)
            parts.append(own)
        self.learn(seen)
        of = self.table.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(of, p)) for p in own) for own in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        where = np.repeat(self.offset[ids] - np.r_[0, np.cumsum(n)][:-1], n)
        where += np.arange(len(where))
        return self.bytes[where].tobytes()


def _library_pretokens(text: str) -> list[str]:
    """Pretokens where characters newer than the pattern's tables occur: as the library cuts them."""
    from tokenizers.pre_tokenizers import ByteLevel

    return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _encode(it: Iterator[pa.RecordBatch], content, check: bool) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(content.value)
    for batch, data, offs in batches(it):
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        ids = vocab.encode(texts)
        exact = [vocab.decode(np.frombuffer(x, "<u4")) == data[a:b].tobytes() for x, a, b in zip(ids, offs[:-1], offs[1:], strict=True)] if check else [None] * len(ids)
        yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(exact, pa.bool_())], ["id", "n_tokens", "ids", "exact"])


def _decode(it: Iterator[pa.RecordBatch], content) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(content.value)
    for batch in it:
        data, offs = string_buffers(batch.column(batch.schema.get_field_index("ids")))
        texts = [vocab.decode(data[a:b].view("<u4")).decode("utf-8", "replace") if b > a else "" for a, b in zip(offs[:-1], offs[1:], strict=True)] if batch.num_rows else []
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def _content(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), exact.

    With ``check``, ``exact`` says whether the ids decode to the very bytes of the text; else it is null.
    """
    content = _content(docs, tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, content, check), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, exact boolean")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with the text that its ids spell, as ``decoded``."""
    content = _content(encoded, tokenizer)
    rows = encoded.select("id", "n_tokens", "ids")
    return rows.mapInArrow(lambda it: _decode(it, content), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
