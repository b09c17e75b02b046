"""Span algebra as column expressions: selection, masking, JSON.

A span is (label, start, end) in bytes, half open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode_classes import TRIM

_SPAN = "array<struct<label:string,start:int,end:int>>"


def placeholder(label: Column) -> Column:
    """``<LABEL>``."""
    return F.concat(F.lit("<"), F.upper(label), F.lit(">"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes ``start:end`` of a string, as a string."""
    return F.substring(text.cast("binary"), start + 1, end - start).cast("string")


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """The span without white space at its ends, as (start, end)."""
    piece = byte_slice(text, start, end)
    left = F.octet_length(piece) - F.octet_length(F.regexp_replace(piece, f"^{TRIM}+", ""))
    right = F.octet_length(piece) - F.octet_length(F.regexp_replace(piece, f"{TRIM}+$", ""))
    return F.struct((start + left).alias("start"), F.greatest(end - right, start + left).alias("end"))


def ordered(spans: Column) -> Column:
    """Spans by start, longer first, then label."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("less"), s["label"].alias("label"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))).cast(_SPAN)


def _sweep(spans: Column) -> Column:
    """Keep, left to right, spans that are not empty and begin at or after the end of the last one kept."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        keep = (s["start"] >= acc["at"]) & (s["end"] > s["start"])
        return F.struct(F.when(keep, s["end"]).otherwise(acc["at"]).alias("at"), F.when(keep, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(spans, zero, step, lambda acc: acc["kept"])


def select_spans(spans: Column, labels: tuple[str, ...], cap: int | None = None) -> Column:
    """Non-overlapping spans: first inside each label, then over all labels; for short lists (copies what it kept at each step).

    ``cap`` keeps only the first spans of each label, in the order given (None keeps all).
    """

    def inside(label: str) -> Column:
        own = F.filter(spans, lambda s: s["label"] == label)
        return _sweep(ordered(own if cap is None else F.slice(own, 1, cap)))

    return _sweep(ordered(F.concat(*map(inside, labels))))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each of sorted, non-overlapping spans replaced by its placeholder."""
    size = F.size(spans)
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    head = F.transform(spans, lambda s, i: F.concat(byte_slice(text, before(i), s["start"]), placeholder(s["label"])))
    tail = byte_slice(text, F.when(size > 0, F.get(spans, size - 1)["end"]).otherwise(0), F.octet_length(text))
    return F.when(spans.isNull() | (size == 0), text).otherwise(F.concat(F.array_join(head, ""), tail))


def json_escaped(text: Column) -> Column:
    """Escapes quotes and backslashes, and every control character as ``\\u00xx``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c in range(0x20):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return out


def spans_json(text: Column, spans: Column) -> Column:
    """``{"spans":[{"label","start","end","text"}]}`` with byte offsets."""
    one = F.transform(
        spans,
        lambda s: F.concat(
            F.lit('{"label":"'), s["label"], F.lit('","start":'), s["start"].cast("string"), F.lit(',"end":'), s["end"].cast("string"), F.lit(',"text":"'),
            json_escaped(byte_slice(text, s["start"], s["end"])), F.lit('"}'),
        ),
    )
    return F.concat(F.lit('{"spans":['), F.array_join(one, ","), F.lit("]}"))
