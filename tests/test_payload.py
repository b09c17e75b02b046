"""JSON walking, splicing, replies and streams."""

import json

import numpy as np
import pytest

from veilframe.operators.payload import ADAPTERS, InvalidJson, decode_string, encode_string, find_fields, splice
from veilframe.operators.redact_payloads import redact_payloads
from veilframe.streaming.redaction import start_replies

CHAT = ADAPTERS["/redact/anthropic"]


def values(text, patterns):
    return [f.value for f in find_fields(text.encode(), patterns)]


def test_paths():
    body = '{"system":"s","messages":[{"content":"a","role":"u"},{"content":[{"text":"b","x":{"text":"no"}}]}],"text":"no"}'
    assert values(body, CHAT) == ["s", "a", "b"]
    assert values('{"text":"t","texts":["u",["v"],"w"]}', ADAPTERS["/redact"]) == ["t", "u", "w"]
    assert values('"bare"', ADAPTERS["/redact"]) == []
    assert values('{"a":' * 40 + '"x"' + "}" * 40, (".".join("a" * 40),)) == []


def test_splice_keeps_other_bytes():
    body = b' {"text" : "a\\/b\\u00e9\\n", "n": [1, 2.50, null ] } trailing'
    fields = find_fields(body, ("text",))
    assert splice(body, fields, [f.value for f in fields]) == ' {"text" : "a/bé\\n", "n": [1, 2.50, null ] } trailing'.encode()


@pytest.mark.parametrize("bad", [b"", b'{"a', b'{"a" 1}', b'{"a":1', b"[1 2]", b"{1:2}", b'{"a":}x'])
def test_invalid(bad):
    if bad == b'{"a":}x':  # bare values are not checked
        assert find_fields(bad, ("a",)) == []
    else:
        with pytest.raises(InvalidJson):
            find_fields(bad, ("a",))
    with pytest.raises(InvalidJson):
        find_fields(bad, ("a",), strict=True)


def test_strings_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(map(chr, rng.choice([1, 8, 9, 10, 12, 13, 34, 47, 92, 97, 233, 0x4E2D, 0x1F600], 12)))
        assert decode_string(json.dumps(text)[1:-1].encode()) == text
        assert json.loads(encode_string(text)) == text
    assert decode_string(b"\\ud83d\\ude00") == "\U0001f600"
    assert encode_string("\x08\x0c") == b'"\\u0008\\u000c"'


def test_replies(spark):
    rows = [
        ("1", "GET", "/any", b""),
        ("2", "POST", "/nope", b"{}"),
        ("3", "POST", "/redact", b'{"text"'),
        ("4", "POST", "/redact", b'{"text":"mail a@b.org now","k":"a@b.org"}'),
        ("5", "POST", "/redact", b'{"text":"lone \\ud800 x a@b.org"}'),
        ("6", "POST", "/redact", None),
    ]
    df = spark.createDataFrame(rows, "payload_id string, method string, route string, body binary")
    got = {r["payload_id"]: (r["status"], bytes(r["body"])) for r in redact_payloads(df).collect()}
    assert got["1"] == (200, b'{"status":"ok"}')
    assert got["2"][0] == 404 and got["3"][0] == 400 and got["6"][0] == 400
    assert got["4"] == (200, b'{"text":"mail <PRIVATE_EMAIL> now","k":"a@b.org"}')
    assert got["5"] == (200, b'{"text":"lone \xed\xa0\x80 x <PRIVATE_EMAIL>"}')


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), "POST", "/redact", f'{{"text":"call +1 (555) 555-12{i:02d}"}}'.encode()) for i in range(20)]
    df = spark.createDataFrame(rows, "payload_id string, method string, route string, body binary")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    start_replies(stream, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    read = lambda x: sorted((r["payload_id"], r["status"], bytes(r["body"])) for r in x.collect())
    assert read(spark.read.parquet(str(tmp_path / "out"))) == read(redact_payloads(df))
