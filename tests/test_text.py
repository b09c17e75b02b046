"""Pretokens, tokens, bytes, readers."""

import base64
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.config import Config
from veilframe.functions.pretokens import compiled, find_pretokens, pretokens, sections, tokens_with_specials
from veilframe.functions.spans import json_escaped, trimmed
from veilframe.operators import tokens
from veilframe.operators.text_bytes import decode_lossy, snap, trim
from veilframe.operators.tokens import Tokenizer, byte_offsets, parse_ranks
from veilframe.plans import api
from veilframe.plans.queries_pipeline import QUERIES, vocabulary_file
from veilframe.sources import readers
from veilframe.sources.vocabulary import rank_table, read_ranks

EDGES = ["", " ", "  x", "I'll DON'T they'Re", "12345 6.78", "a\r\n\r\nb", "x 　 y\u0085z", "中文 ABCdef ́a", "path/to\n//x", "\t\t a  \n", "ÉCOLE été", "A" * 600, "a῿b"]


def test_pretokens_match_the_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    for r in df.select("i", "t", pretokens(F.col("t")).alias("p"), pretokens(F.col("t"), fallback=True).alias("f")).collect():
        assert r["p"] == r["f"] == compiled().findall(r["t"])
        assert "".join(r["p"]) == r["t"]


def test_new_letters_take_the_fallback(spark):
    text = "a\U00031350\U00031351 b"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(pretokens(F.col("t"), fallback=True)).first()[0] == find_pretokens(text) == [text[:-2], " b"]
    assert find_pretokens("a\u0558b c") == ["a", "\u0558b", " c"]  # not yet a letter in the tables


def test_special_literals(spark):
    text = "ab <|endoftext|><|endofprompt|> c"
    got = spark.createDataFrame([(text,)], "t string").select(tokens_with_specials(F.col("t"))).first()[0]
    assert got == ["ab", " ", "<|endoftext|>", "<|endofprompt|>", " c"]
    ids, cut = Tokenizer(None).encode(text)
    assert 199999 in ids and 200018 in ids and cut[-1] == len(text)
    assert 199999 not in Tokenizer(None, specials=False).encode(text)[0]


def test_many_sections_take_linear_time(spark):  # F8
    df = spark.createDataFrame([(1, "ab<|endoftext|>c<|endofprompt|>" * 15_000), (2, "a<|endofprompt|>"), (3, ""), (4, None)], "i int, t string")
    began = time.time()
    got = df.select("i", F.posexplode(sections(F.col("t"))).alias("n", "s")).select("i", "n", "s.piece", "s.literal").collect()
    assert time.time() - began < 20
    assert [tuple(r)[2:] for r in got[:30_001]] == [("ab", "<|endoftext|>"), ("c", "<|endofprompt|>")] * 15_000 + [("", None)]
    assert [tuple(r) for r in got[30_001:]] == [(2, 0, "a", "<|endofprompt|>"), (2, 1, "", None), (3, 0, "", None)]


def merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_bpe_is_lowest_rank_first(spark):
    ranks = read_ranks(spark, vocabulary_file())
    assert len(ranks) == 50256
    tok = Tokenizer(ranks, specials=False)
    for text in [*EDGES, "the quick brownish fox's tail"]:
        want = list(itertools.chain.from_iterable([ranks[p.encode()]] if p.encode() in ranks else merge(p.encode(), ranks) for p in compiled().findall(text)))
        ids, cut = tok.encode(text)
        assert ids.tolist() == want
        assert cut[-1] == len(text.encode())


def test_rank_files_are_read_where_they_are(spark, tmp_path):  # F1
    path = f"{tmp_path}/x.tiktoken"
    with open(path, "wb") as f:
        f.write(b"YQ== 0\n\nYmM= 1\r\nYQ==\nYQ== 2 3\n/w== 4")
    want = {b"a": 0, b"bc": 1, b"\xff": 4}
    assert read_ranks(spark, f"file://{path}") == want
    table = rank_table(spark, f"file://{path}")
    hadoop = spark._jsc.hadoopConfiguration()
    usual = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://elsewhere/")
    try:
        assert read_ranks(spark, path) == want
        assert rank_table(spark, path).dtypes == table.dtypes and rank_table(spark, path).collect() == table.collect()
    finally:
        hadoop.set("fs.defaultFS", usual)


def test_bpe_tokens_of_odd_texts(spark, tmp_path):  # F1
    ranks = read_ranks(spark, vocabulary_file())
    long = 1_200_000
    texts = [None, b"", b" ", b"a\xff b", b"ab<|endoftext|>", b" " * long, b"x" + b"\t" * long + b"y", b"!\n" + b" " * long + b"<|endofprompt|>"]
    rows = spark.createDataFrame([(i, t and bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary")
    rows.select("doc_id", F.col("text").cast("string").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    table = QUERIES["bpe_tokens"](spark, str(tmp_path))
    assert dict(table.dtypes) == {"doc_id": "bigint", "n_tokens": "int", "ids": "array<int>", "n_bytes": "int"}
    got = {r["doc_id"]: r for r in table.collect()}
    want = {i: Tokenizer(ranks).encode((t or b"").decode("utf-8", "replace"))[0].tolist() for i, t in enumerate(texts[:5])}
    want[5] = merge_alike(b" ", long, ranks)
    want[6] = [ranks[b"x"], *merge_alike(b"\t", long - 1, ranks), *([ranks[b"\ty"]] if b"\ty" in ranks else [ranks[b"\t"], ranks[b"y"]])]
    want[7] = [*([ranks[b"!\n"]] if b"!\n" in ranks else [ranks[b"!"], ranks[b"\n"]]), *merge_alike(b" ", long, ranks), 200018]
    for i, t in enumerate(texts):
        assert (got[i]["ids"], got[i]["n_tokens"], got[i]["n_bytes"]) == (want[i], len(want[i]), len(t or b""))


def test_bpe_tokens_keep_the_type_of_ids(spark, tmp_path):  # F1
    docs = spark.createDataFrame([("7-1", "a b"), (None, "")], "doc_id string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_bytes"] for r in QUERIES["bpe_tokens"](spark, str(tmp_path)).collect()} == {"7-1": 3, None: 0}
    assert {r["doc_id"]: len(r["toks"]) for r in tokens.bpe_tokens(docs, None).collect()} == {"7-1": 2, None: 0}
    whole = docs.select(F.lit(3).cast("decimal(38,0)").alias("doc_id"), "text")
    assert tokens.bpe_tokens(whole, None).dtypes[0] == ("doc_id", "decimal(38,0)") and tokens.bpe_tokens(whole, None).first()[0] == 3


def merge_alike(char, n, ranks):
    assert char * 2 not in ranks
    return [ranks[char]] * n


def test_cut_texts_give_the_same_tokens(spark, monkeypatch):  # F1
    ranks, pick = read_ranks(spark, vocabulary_file()), random.Random(7)
    signs = [*" \t\x0b\u3000\xa0\u2028\x85\n\r" * 2, *"aA1.!/'sé中\u0301_\x1c", "<|endoftext|>", "<|endofprompt|>", "<|endof"]
    for specials in (True, False):
        tok = Tokenizer(ranks, specials)
        for _ in range(20_000):
            text = "".join(pick.choices(signs, k=pick.randint(0, 14)))
            monkeypatch.setattr(tokens, "LONG_RUN", pick.randint(2, 4))
            want = tok.encoding.encode(text, allowed_special="all") if specials else tok.encoding.encode_ordinary(text)
            assert tok.encode(text)[0].tolist() == want, text


def test_toy_ranks():
    lines = [(base64.b64encode(bytes([b])).decode(), b) for b in range(256)] + [(base64.b64encode(b"ab").decode(), 256), (base64.b64encode(b"abab").decode(), 257)]
    assert Tokenizer(parse_ranks(lines)).encode("ababab")[0].tolist() == [257, 256]


def test_byte_offsets():
    text = "aé中\U0001f600z"
    assert byte_offsets(text).tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_snap_and_trim(spark):
    data = " 　 xé \x1c\t".encode()
    assert data[slice(*trim(data, 0, len(data)))] == "xé".encode()
    assert snap("a中b".encode(), 2, 3) == (1, 4)
    row = spark.createDataFrame([(data.decode(),)], "t string").select(trimmed(F.col("t"), F.lit(0), F.octet_length("t")).alias("s")).first()["s"]
    assert (row["start"], row["end"]) == trim(data, 0, len(data))
    assert trim(b"   ", 0, 3)[0] == trim(b"   ", 0, 3)[1]
    assert decode_lossy(b"a\xff\xc3\xa9") == ("a�é", [0, 1, 2])


def test_lines_end_only_at_line_feeds(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\r\nb\rc\n\nlast")
    got = [r["text"] for r in readers.line_files(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == ["a\r", "b\rc", "", "last"]
    df = spark.createDataFrame([(1, "a\r\nb\rc\n\nlast\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r["line"] for r in readers.doc_lines(df).orderBy("line_no").collect()] == got


def test_whole_files_and_words(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"ok\xff\n")
    assert readers.whole_files(spark, str(tmp_path)).first()["valid"] is False
    assert readers.from_words(spark, ["a", "b"]).first()["text"] == "a b"


def test_json_escapes_all_controls(spark):
    text = "".join(map(chr, range(1, 33))) + '"\\é'
    got = spark.createDataFrame([(text,)], "t string").select(json_escaped(F.col("t"))).first()[0]
    assert got == "".join(f"\\u{c:04x}" for c in range(1, 32)) + ' \\"\\\\é'


def test_detection_of_each_rule(spark):
    rows = [(1, "mail bob.x@ex.org, call +1 (555) 555-1234."), (2, "card 1234 5678 9012 3456 on 2024-02-03"), (3, 'token = "abcdef0123456789abcdef" see https://a.b/c?d=e.'), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["masked"] for r in api.redact(docs).collect()}
    assert got[1] == "mail <PRIVATE_EMAIL>, call <PRIVATE_PHONE>."
    assert got[2] == "card <ACCOUNT_NUMBER> on <PRIVATE_DATE>"
    assert got[3] == 'token = "<SECRET>" see <PRIVATE_URL>.'
    assert got[5] == ""


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = sorted(api.redact(docs.coalesce(1)).collect())
    assert one == sorted(api.redact(docs.repartition(7)).collect())


@pytest.mark.parametrize("bad", [{"n_ctx": 0}, {"batch": 0}, {"skip_beta": -1}, {"span_cap": -1}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_labels_with_numpy_view():
    assert np.diff(Tokenizer(None).encode("one two")[1]).tolist() == [3, 4]
