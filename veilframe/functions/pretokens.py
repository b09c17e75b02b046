"""Pretokens, byte offsets and special tokens as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode_classes import PRETOKEN, needs_fallback, python_pattern

# Special tokens and their ids.
SPECIALS = {"<|endoftext|>": 199999, "<|endofprompt|>": 200018}
_SPLIT = r"<\|endoftext\|>|<\|endofprompt\|>"


@lru_cache(maxsize=1)
def compiled():
    import regex

    return regex.compile(python_pattern())


_PLAIN = re.compile(r"[^\x00-\u024f]")
_UNASSIGNED = "\u0378"  # in every Unicode version so far


def find_pretokens(text: str) -> list[str]:
    """Pretokens by Python's ``regex``, with classes of the Unicode version of ``unicodedata``.

    ``regex`` may know later characters; those stand for unassigned ones while matching, one for one.
    """
    if not _PLAIN.search(text):
        return compiled().findall(text)
    late = [c for c in set(text) if unicodedata.category(c) == "Cn"]
    if not late:
        return compiled().findall(text)
    out, at = [], 0
    for piece in compiled().findall(text.translate(dict.fromkeys(map(ord, late), _UNASSIGNED))):
        out.append(text[at : at + len(piece)])
        at += len(piece)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _python_pretokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else find_pretokens(t))


def pretokens(text: Column, fallback: bool = False) -> Column:
    """Consecutive pieces of ``text`` whose concatenation is ``text``; special literals are ordinary text here.

    ``fallback`` routes texts with characters newer than the JVM to a Python function (one more stage).
    """
    native = F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))
    if not fallback:
        return native
    return F.when(needs_fallback(text), _python_pretokens(F.when(needs_fallback(text), text))).otherwise(native)


def sections(text: Column) -> Column:
    """``text`` cut at special literals: array of (piece, literal); the text before a literal ends there."""
    literals = F.regexp_extract_all(text, F.lit(_SPLIT), F.lit(0))
    pieces = F.split(text, _SPLIT, -1)
    return F.arrays_zip(pieces, literals).cast("array<struct<piece:string,literal:string>>")  # inside a lambda, literals would be found anew for each piece


def tokens_with_specials(text: Column) -> Column:
    """Pretokens of ``text`` in which special literals stand as tokens of their own."""
    parts = F.transform(sections(text), lambda s: F.concat(F.regexp_extract_all(s["piece"], F.lit(PRETOKEN), F.lit(0)), F.when(s["literal"].isNull(), F.array().cast("array<string>")).otherwise(F.array(s["literal"]))))
    return F.flatten(parts)


def byte_ranges(pieces: Column) -> Column:
    """Start and end byte of each of consecutive pieces: array of (piece, bs, be)."""
    step = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda acc, p: F.struct((acc["at"] + F.octet_length(p)).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + F.octet_length(p))).alias("ends")),
        lambda acc: acc["ends"],
    )
    return F.zip_with(pieces, step, lambda p, e: F.struct(p.alias("piece"), (e - F.octet_length(p)).alias("bs"), e.alias("be")))
