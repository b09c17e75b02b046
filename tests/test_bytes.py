"""Texts with bytes that are no UTF-8, long lists of spans, and the path through a model's folder."""

import io
import json
import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F
from test_transformer import naive

from veilframe.__main__ import main
from veilframe.config import Config
from veilframe.operators import span_lists
from veilframe.operators.detect import RunStats
from veilframe.operators.payload import encode_string
from veilframe.operators.redact_payloads import redact_payloads
from veilframe.operators.rules import hits
from veilframe.operators.text_bytes import readable
from veilframe.operators.tokens import bpe_tokens
from veilframe.operators.transformer import Dims
from veilframe.plans import api
from veilframe.plans.queries_pipeline import transformer_labels, vocabulary_file
from veilframe.plans.seeded import seeded_tensors
from veilframe.sources.tensors import write_tensors
from veilframe.streaming.redaction import start_redaction

BROKEN = b"mail a@b.co \xff\xfe end \xc3\xa9\xc3 c@d.org \xf0\x9f"
MASKED = b"mail <PRIVATE_EMAIL> \xff\xfe end \xc3\xa9\xc3 <PRIVATE_EMAIL> \xf0\x9f"


def table(spark, *texts):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary").select("doc_id", F.col("text").cast("string").alias("text"))


def raw(df, column):
    return {r[0]: bytes(r[1]) for r in df.select("doc_id", F.col(column).cast("binary")).collect()}


def test_places_of_broken_bytes():
    text, place = readable(b"a\xff\xc3\xa9\xfeb")
    assert text == "a�é�b" and place.tolist() == [0, 1, 1, 1, 2, 3, 4, 4, 4, 5, 6]
    assert readable("aé".encode())[1] is None


def test_places_of_many_bytes_take_little_time_and_memory():  # F2
    data = b"\xff " + "plain text, é 中 \U0001f600 ".encode() * 120_000 + b"\xed\xa0\x80 \xc3("
    began = time.process_time()
    text, place = readable(data)
    assert time.process_time() - began < 0.5
    assert text[0] == "\ufffd" and text.endswith("\ufffd" * 3 + " \ufffd(") and place[-1] == len(data)
    whole = np.frombuffer(text.encode(), np.uint8)
    same = slice(3, -14)  # what stands between the broken bytes
    assert (whole[same] == np.frombuffer(data, np.uint8)[place[:-1][same]]).all()
    assert (len(data) - place[-15:]).tolist() == [6, 6, 6, 5, 5, 5, 4, 4, 4, 3, 2, 2, 2, 1, 0]
    tracemalloc.start()
    readable(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(data)


def test_places_of_odd_bytes_by_a_plain_loop():  # F5
    pick = random.Random(1)
    parts = [b"a", b"\xff", b"\xc3", "é".encode(), "中".encode(), b"\xe4\xb8", "\U0001f600".encode(), b"\xf0\x9f", b"\xed\xb2\x80", "\ufffd".encode(), b"\xc0\x80", b"\x00"]
    for _ in range(2000):
        data = b"".join(pick.choices(parts, k=pick.randint(0, 12))) + b"\xff"
        text, want, at = "", [], 0
        for c in data.decode("utf-8", "surrogateescape"):
            raw = "\udc80" <= c <= "\udcff"
            want += [at] * 3 if raw else range(at, at + len(c.encode()))
            at += 1 if raw else len(c.encode())
            text += "\ufffd" if raw else c
        got = readable(data)
        assert (got[0], got[1].tolist()) == (text, [*want, at])


def test_broken_bytes_pass_unchanged(spark, tmp_path):
    docs = table(spark, BROKEN, b"\xff", b"")
    assert raw(api.redact(docs), "masked") == {0: MASKED, 1: b"\xff", 2: b""}
    spans = api.detect(docs).where("doc_id = 0").first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(5, 11), (BROKEN.index(b"c@d"), BROKEN.index(b"c@d") + 7)]
    assert b'"start":5,"end":11' in raw(api.span_records(docs), "json")[0]
    ends = {r[0]: r[1] for r in bpe_tokens(docs, None).select("doc_id", F.element_at("toks", -1)["be"]).where("doc_id < 2").collect()}
    assert ends == {0: len(BROKEN), 1: 1}
    body = b'{"text": "' + BROKEN + b'"}'
    rows = spark.createDataFrame([("p", "POST", "/redact", bytearray(body))], "payload_id string, method string, route string, body binary")
    assert bytes(redact_payloads(rows).first()["body"]) == b'{"text": "' + MASKED + b'"}'
    docs.write.parquet(f"{tmp_path}/in")
    start_redaction(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/c", once=True).awaitTermination()
    assert raw(spark.read.parquet(f"{tmp_path}/out"), "masked")[0] == MASKED


def test_broken_bytes_on_the_command_line(spark, capsysbinary, tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(BROKEN)
    assert main(["-f", str(tmp_path / "x")]) == 0
    assert capsysbinary.readouterr().out == MASKED + b"\n"

    class Stdin:
        buffer = io.BytesIO(BROKEN + b"\nplain\n")

    monkeypatch.setattr("sys.stdin", Stdin)
    assert main(["-f", "-", "--lines"]) == 0
    assert capsysbinary.readouterr().out == MASKED + b"\nplain\n"
    assert main([BROKEN.decode("utf-8", "surrogateescape")]) == 0
    assert capsysbinary.readouterr().out == MASKED + b"\n"


def test_strings_with_lone_surrogates_and_broken_bytes():
    assert encode_string("a\udcff\ud800b") == b'"a\xff\xed\xa0\x80b"'


def test_many_hits_take_linear_time(spark):
    text = "x@y.org +1 (555) 123-4567 " * 16_000
    began = time.time()
    found = hits(text)
    assert len(found) == 32_000 and found == sorted(found, key=lambda h: h[1]) and time.time() - began < 5
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert api.redact(docs).first()["masked"] == "<PRIVATE_EMAIL> <PRIVATE_PHONE> " * 16_000
    assert time.time() - began < 25
    spans = [{"label": "a", "start": i, "end": i + 3} for i in range(50_000)]
    began = time.time()
    assert len(span_lists.select(spans)) == 16_667 and time.time() - began < 2


DIMS = Dims(d=16, layers=2, heads=4, kv_heads=2, head=8, experts=6, top=4, ff=12, vocab=200_019, band=128)


def test_a_models_folder_end_to_end(spark, capsys, tmp_path):
    """Labels, masks, probabilities and counts through the folder of a model with seeded weights, against the loop version."""
    tensors = seeded_tensors(DIMS, 3)
    write_tensors(str(tmp_path / "model.safetensors"), tensors)
    (tmp_path / "ranks.tiktoken").write_bytes(open(vocabulary_file(), "rb").read())
    config = Config(model=str(tmp_path), argmax=True)
    texts = ["Ann wrote to Bob on Friday", "no", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in api.logprobs(docs, config).collect()}
    for i, t in enumerate(texts[:2]):
        lp = np.array(got[i]["lp"])
        assert np.allclose(lp, naive(tensors, DIMS, got[i]["ids"]), atol=2e-3) and len(lp) == len(got[i]["ids"])
    assert got[2]["ids"] == []
    stats = RunStats.of(spark)
    masked = {r["doc_id"]: r["masked"] for r in api.redact(docs, config, stats=stats).collect()}
    n = sum(len(r["ids"]) for r in got.values())
    assert masked[2] == "" and stats.docs.value == 3 and stats.tokens.value == n and stats.batches.value >= 1 and f"{n} tok" in str(stats)
    assert main(["--model", str(tmp_path), "--dump-logprobs", texts[0]]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split()[:2] for x in lines] == [[str(t), str(i)] for t, i in enumerate(got[0]["ids"])] and all(len(x.split()) == 35 for x in lines)
    assert main(["--model", str(tmp_path), "--argmax", "--stats", texts[0]]) == 0
    said = capsys.readouterr()
    assert said.out == masked[0] + "\n" and "tok/s" in said.err
    tensors.pop("norm.scale")
    write_tensors(str(tmp_path / "model.safetensors"), tensors)
    try:
        api.redact(docs, config)
    except KeyError as error:
        assert "norm.scale" in str(error)
    else:
        raise AssertionError("a missing tensor must stop the run")


def test_labels_of_the_registered_transformer(spark):
    """``transformer_labels`` against labels by the loop version and a plain search over its probabilities."""
    from veilframe.operators.decode import label_runs, transition_matrix
    from veilframe.operators.tokens import Tokenizer
    from veilframe.schema import CATEGORIES

    dims = Dims(d=32, layers=2, heads=4, kv_heads=2, head=8, experts=8, top=4, ff=16, vocab=512, band=8)
    sf = "/root/testdata/sf0.001"
    got = {}
    for r in transformer_labels(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["label"], r["bs"], r["be"]))
    tensors, tok, move = seeded_tensors(dims, 7), Tokenizer(None), transition_matrix()
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.length("text")).limit(4).collect()
    for row in rows:
        ids, bounds = tok.encode(row["text"])
        lp = np.concatenate([naive(tensors, dims, ids[lo : lo + 64] % dims.vocab) for lo in range(0, len(ids), 64)])
        tag = (np.arange(33) - 1) % 4
        first = np.where((np.arange(33) == 0) | (tag == 0) | (tag == 3), 0, -1e9)
        last = np.where((np.arange(33) == 0) | (tag == 2) | (tag == 3), 0, -1e9)
        best, back = lp[0] + first, []
        for x in lp[1:]:
            step = best[:, None] + move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + x
        path = [int((best + last).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        labels = np.array(path[::-1], np.uint8)
        data = row["text"].encode()
        want = []
        for c, a, b in zip(*label_runs(labels, np.array([0, len(labels)])), strict=True):
            piece = data[bounds[a] : bounds[b + 1]]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                want.append((CATEGORIES[c], int(bounds[a]) + lead, int(bounds[a]) + lead + len(piece.strip())))
        assert got.get(row["item_id"], []) == want


def test_json_of_spans_parses(spark):
    docs = spark.createDataFrame([(1, 'say "a@b.org"\n')], "doc_id long, text string")
    assert json.loads(api.span_records(docs).first()["json"])["spans"][0]["text"] == "a@b.org"
