"""JSON payloads: find the strings at given paths and put masked strings in their place, all other bytes kept.

The walker is iterative, so nesting is bounded by memory only.  It is as lenient as the services it serves: bare
values are not checked, and bytes after the value stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

MAX_DEPTH = 32

# Payload formats and the paths that carry user text.
ADAPTERS = {
    "/redact": ("text", "texts.*"),
    "/redact/openai": ("messages.*.content", "messages.*.content.*.text"),
    "/redact/anthropic": ("system", "system.*.text", "messages.*.content", "messages.*.content.*.text"),
}

_SPACE = re.compile(rb"[ \t\n\r]*")
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.DOTALL)
_BARE = re.compile(rb"[^,\]} \t\n\r]*")
_ESCAPE = re.compile(rb"\\(u[0-9A-Fa-f]{4}|.)", re.DOTALL)
_SIMPLE = {b"b": "\b", b"f": "\f", b"n": "\n", b"r": "\r", b"t": "\t"}
_CONTROL = re.compile(r'["\\\x00-\x1f]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


class InvalidJson(ValueError):
    pass


class Field(NamedTuple):
    """A matched string: its byte range with quotes, and its value."""

    start: int
    end: int
    value: str


def decode_string(body: bytes) -> str:
    """The value of a JSON string body; a lone surrogate stays one (``surrogatepass``), other escapes stand for themselves."""
    if b"\\" not in body:
        return body.decode("utf-8", "surrogateescape")
    out: list[str] = []
    pos = 0
    for m in _ESCAPE.finditer(body):
        out.append(body[pos : m.start()].decode("utf-8", "surrogateescape"))
        pos = m.end()
        code = m[1]
        if len(code) == 5:
            out.append(chr(int(code[1:], 16)))
        else:
            out.append(_SIMPLE.get(code) or code.decode("utf-8", "surrogateescape"))
    out.append(body[pos:].decode("utf-8", "surrogateescape"))
    joined = "".join(out)
    return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), joined)


def encode_string(value: str) -> bytes:
    """A JSON string with quotes; non-ASCII characters stay as they are."""
    body = _CONTROL.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", value)
    parts = re.split("([\udc80-\udcff]+)", body)  # bytes that are no UTF-8, between well-formed text and lone surrogates
    return b'"' + b"".join(p.encode("utf-8", "surrogateescape" if i % 2 else "surrogatepass") for i, p in enumerate(parts)) + b'"'


def _matcher(patterns: tuple[str, ...]) -> Callable[[list[bytes | None]], bool]:
    parts = [[s.encode() for s in p.split(".")] for p in patterns]

    def match(path: list[bytes | None]) -> bool:
        if len(path) > MAX_DEPTH:
            return False
        return any(len(p) == len(path) and all(want == b"*" or want == got for want, got in zip(p, path, strict=True)) for p in parts)

    return match


def find_fields(data: bytes, patterns: tuple[str, ...], strict: bool = False) -> list[Field]:
    """Strings of the first JSON value of ``data`` whose path matches; raises InvalidJson."""
    if strict:
        import json

        try:
            json.loads(data)
        except ValueError as error:
            raise InvalidJson(str(error)) from None
    match = _matcher(patterns)
    out: list[Field] = []
    path: list[bytes | None] = []  # keys as written; None for an array index
    i = 0

    def string_at(at: int) -> re.Match[bytes]:
        m = _STRING.match(data, at)
        if not m:
            raise InvalidJson(f"unterminated string at byte {at}")
        return m

    def key_at(at: int) -> int:
        """Read ``"key":`` and return where its value starts."""
        at = _SPACE.match(data, at).end()
        if data[at : at + 1] != b'"':
            raise InvalidJson(f"key expected at byte {at}")
        m = string_at(at)
        at = _SPACE.match(data, m.end()).end()
        if data[at : at + 1] != b":":
            raise InvalidJson(f"colon expected at byte {at}")
        path[-1] = m[0][1:-1]
        return at + 1

    closers: list[bytes] = []
    while True:
        i = _SPACE.match(data, i).end()
        c = data[i : i + 1]
        if not c:
            raise InvalidJson("value expected at the end")
        done = True
        if c == b'"':
            m = string_at(i)
            if match(path):
                out.append(Field(i, m.end(), decode_string(m[0][1:-1])))
            i = m.end()
        elif c in b"{[":
            close = b"}" if c == b"{" else b"]"
            i = _SPACE.match(data, i + 1).end()
            if data[i : i + 1] == close:
                i += 1
            else:
                closers.append(close)
                path.append(None)
                if c == b"{":
                    i = key_at(i)
                done = False
        else:
            i = _BARE.match(data, i).end()
        while done:
            if not closers:
                return out
            i = _SPACE.match(data, i).end()
            c = data[i : i + 1]
            if c == b",":
                i = key_at(i + 1) if closers[-1] == b"}" else i + 1
                done = False
            elif c == closers[-1]:
                closers.pop()
                path.pop()
                i += 1
            else:
                raise InvalidJson(f"comma or end expected at byte {i}")


def splice(data: bytes, fields: list[Field], values: list[str]) -> bytes:
    """``data`` with the fields' strings replaced by ``values``, encoded anew."""
    out, pos = [], 0
    for f, v in zip(fields, values, strict=True):
        out += [data[pos : f.start], encode_string(v)]
        pos = f.end
    return b"".join([*out, data[pos:]])
