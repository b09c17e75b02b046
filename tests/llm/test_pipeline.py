"""The pipeline against a plain version of its stages."""

import re

import corpus_pipeline
import numpy as np

SF = "/root/testdata/sf0.001"


def run_stages(spark, docs, sf, tmp_path):
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
    return docs, sizes


def brute(documents, benchmark, sites=10):
    from tokenizers import Tokenizer

    from veilframe.llm.queries_op6 import tokenizer_file

    docs = {i: t for i, t in zip(documents.doc_id, documents.text, strict=True) if t and any(c.isalpha() for c in t)}
    source = dict(zip(documents.doc_id, documents.source, strict=True))
    spread, first = {}, {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            s = line.strip(" \t\n\x0b\x0c\r")
            if len(s.encode().split()) >= 3:
                spread.setdefault(s, set()).add(source[i])
                first.setdefault(s, i)
    kept = {i: "\n".join(x for x in t.split("\n") if len(spread.get(s := x.strip(" \t\n\x0b\x0c\r"), ())) < sites or first[s] == i) for i, t in docs.items()}
    sets = {}
    for i, t in kept.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(t) for t in benchmark.text]
    lib = Tokenizer.from_file(tokenizer_file())
    return {i: lib.encode(kept[i], add_special_tokens=False).ids for i in ids if find(i) == i and not any(b in plain(kept[i]) for b in items)}


def test_equals_plain_version(spark, duck, tmp_path):
    docs, _ = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in docs.collect()}
    want = brute(duck.sql("SELECT * FROM documents").df(), duck.sql("SELECT * FROM benchmark").df())
    assert got == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(want)


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    docs, sizes = run_stages(spark, odd.withColumn("n_chars", odd.doc_id), SF, tmp_path)
    assert sizes[0] == odd.count() - 4  # null, empty, blank and digits only
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert {1, 10, 11} <= set(rows) and 9 not in rows and all(r["exact"] for r in rows.values())


def test_empty_table(spark, nothing, tmp_path):
    _, sizes = run_stages(spark, nothing.withColumn("n_chars", nothing.doc_id), SF, tmp_path)
    assert sizes == [0] * len(corpus_pipeline.STAGES)


def test_rows_of_one_id_and_reserved_names(spark):
    """A letterless row takes no other row of its id with it; columns named like the stages' own pass all of them."""
    rows = [(1, "hello there you and all of them", "en", "a"), (1, "123", "en", "a"), (2, "quite another text for the test", "en", "b"), (None, "a text without an id", "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("gone", "gone_", "__gone", "__id", "__row", "ID_"):
        docs = docs.withColumn(name, docs["lang"])
    kept = corpus_pipeline.detect_language(spark, docs, SF)
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for _, t, _, _ in rows if t != "123")
    out = kept
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert out.count() == 3


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from veilframe.llm.tables import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[3,2,1024]"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Session())
