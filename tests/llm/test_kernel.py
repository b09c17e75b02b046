import numpy as np
import pyarrow as pa

from veilframe.llm import textkernel as k


def column(texts):
    return k.string_buffers(pa.array(texts, pa.string()))


def test_words_are_runs_without_ascii_space(monkeypatch):
    monkeypatch.setattr(k, "PIECE", 64)
    monkeypatch.setattr(k, "_POWERS", [])
    texts = ["a bb  ccc", None, "", " \x0b\x0c", "é\u00a0x \u2003y", "long" * 100 + " z", "tail ", "w" * 63 + " " + "v" * 64 + " u" * 40]
    data, offs = column(texts)
    w = k.words(data, offs)
    assert [w.text(i).decode() for i in range(len(w.start))] == [x for t in texts for x in (b.decode() for b in (t or "").encode().split())]
    assert np.diff(w.first).tolist() == [len((t or "").encode().split()) for t in texts]


def test_hashes_depend_on_the_word_only():
    data, offs = column(["alpha beta gamma alpha", "GAMMA beta", "ab ba a b"])
    h = k.words(data, offs, lower=True).hash
    assert h[0] == h[3] and h[1] == h[5] and h[2] == h[4]
    assert len(set(h[6:].tolist())) == 4
    assert k.words(data, offs).hash[2] != k.words(data, offs).hash[4]


def test_sliced_columns_and_batches():
    arr = pa.array(["a", "bb", None, "cc d"]).slice(1)
    data, offs = k.string_buffers(arr)
    assert np.diff(k.words(data, offs).first).tolist() == [1, 0, 2]
    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * 50] * 6)], ["id", "text"])
    assert [b.num_rows for b, _, _ in k.batches(iter([batch]), most=100)] == [2, 2, 2]
    assert [b.num_rows for b, _, _ in k.batches(iter([batch]), most=1)] == [1] * 6


def test_lower_case_of_two_byte_letters():
    text = "ÀÉß Ωμ ДЖ İ 中 Zz"
    got = k.lower_case(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()
    assert got == "àéß ωμ дж İ 中 zz"


def test_bytes_that_are_not_utf8(spark):
    from pyspark.sql import functions as F

    from veilframe.llm import brown_lm, decontamination, language_id, near_dedup, substring_dedup

    df = spark.createDataFrame([(1, bytearray(b"a\xff b\xc3 " + b"w " * 20)), (2, bytearray(b"a\xff b\xc3 " + b"w " * 20))], "doc_id long, raw binary")
    df = df.select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("en").alias("lang"))
    assert [r["n_removed"] for r in substring_dedup.dedup_substrings(df).select("id", "n_removed").orderBy("id").collect()] == [0, 22]
    assert [r["component"] for r in near_dedup.near_duplicates(df).collect()] == [1, 1]
    assert brown_lm.score(df, *brown_lm.train(df)).count() == 2
    assert language_id.identify(df, language_id.learn(df)).count() == 2
    assert decontamination.contaminated(df, df.withColumnRenamed("doc_id", "item_id")).count() == 2
