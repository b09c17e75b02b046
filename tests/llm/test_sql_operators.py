"""Operators with SQL agree with it on a whole small table and on odd rows."""

import duckdb
import pytest
from comparing import same_rows

from veilframe.llm import line_dedup, queries_op1, queries_op3, queries_op4, queries_op8, queries_op10
from veilframe.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]).df())


DOCUMENTS = {
    "op1": (queries_op1.op1_substring_dedup, queries_op1.ORACLE),
    "op3": (queries_op3.op3_minhash_near_dedup, queries_op3.ORACLE),
    "op4": (queries_op4.op4_block_naming, queries_op4.ORACLE),
    "op10": (queries_op10.op10_line_dedup, queries_op10.ORACLE),
}


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_odd_rows(spark, odd, tmp_path, name):
    """Unique known ids as SQL takes them; then all rows, which must not fail and keep their number."""
    query, sql = DOCUMENTS[name]
    plain = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    documents = plain.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    same_rows(query(spark, str(tmp_path)), con.sql(sql).df())
    odd.write.parquet(f"{tmp_path}/all/documents.parquet")
    assert query(spark, f"{tmp_path}/all").count() == odd.count()
    odd.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert query(spark, f"{tmp_path}/none").count() == 0


def test_substrings_of_null_ids_and_repeats(odd):
    from veilframe.llm.substring_dedup import dedup_substrings

    got = dedup_substrings(odd).toPandas()
    assert got[got.id.isna()].n_removed.tolist() == [0]
    assert got[got.id == 2].n_removed.tolist() == [15, 15]
    assert got[got.id == 1].n_removed.tolist() == [0]
    spans = got[got.id == 13].spans.iloc[0]
    assert [(s["start"], s["end"]) for s in spans] == [(0, 30)]


def test_substring_against_brute_force(spark):
    import random

    from veilframe.llm.substring_dedup import dedup_substrings

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["kept_text"] for r in dedup_substrings(df, length=7, k=3).collect()}
    seen = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 6):
            seen.setdefault(tuple(w[j : j + 7]), i)
    for i, t in rows:
        w = t.split()
        gone = {k for j in range(len(w) - 6) if seen[tuple(w[j : j + 7])] < i for k in range(j, j + 7)}
        assert got[i] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_near_copies_in_a_large_group(spark, duck):
    """Hundreds of copies with random edits: components equal those of all pairs."""
    import random

    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(x if rnd.random() > e else f"y{rnd.randrange(999)}" for x in base)) for i, e in enumerate([0.01, 0.03, 0.06, 0.1, 0.2] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    from veilframe.llm.near_dedup import near_duplicates

    got = near_duplicates(df, n=2).toPandas().rename(columns={"id": "doc_id", "component": "component_id"})
    want = con.sql(queries_op3.ORACLE).df()
    same_rows(spark.createDataFrame(got), want)


def test_components_of_a_chain(spark):
    from veilframe.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in (100, 101, 102))
    assert components(edges.where("false")).count() == 0


def test_block_names_across_levels(spark):
    from veilframe.llm.exact_dedup import name_documents

    a = "abcdefgh" * 40
    rows = [(1, a), (2, a + " "), (3, a[:-1] + "X"), (4, "abcdefgh"), (5, "ab cd\nefgh"), (6, None), (7, ""), (8, a[8:] + "abcdefgh")]
    got = name_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=16).toPandas().set_index("id")
    assert got.keep_id.to_dict() == {1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 6, 8: 2}
    assert got.group_size[6] == 2 and got.group_size[1] == 3


def test_lines_need_enough_sites(spark):
    wide, narrow = "a line of many sites", "a line of few sites"
    rows = [(i, f"{wide}\nown {i} text\n{narrow}\nshort", f"s{i % 12}" if i < 12 else None) for i in range(15)] + [(20, None, "s1"), (21, "", "s1"), (None, wide, "s40")]
    rows = [(i, (t or "").replace(narrow, "") if t and i is not None and i > 8 else t, s) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df).collect()}
    assert got[0].startswith(wide) and got[3] == f"own 3 text\n{narrow}\nshort"
    assert got[14] == "own 14 text\n\nshort" and got[20] is None and got[21] == "" and got[None] == wide


def test_rules_and_reputation(spark):
    from veilframe.llm.url_reputation import Rule, judge

    urls = [None, "nothing", "http://EXAMPLE.com/en/x?y", "https://a.www.example.com/en/", "x://example.com", "http://net/es/1", "http://b.net#f", "http://evil.org/bad/1"] + [f"http://evil.org/bad/{i}" for i in range(50)] + [f"http://fine.org/good/{i}" for i in range(20)] + ["http://evil.org/other", "http://fresh.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge(df).toPandas().set_index("id")
    assert got["rule"][[2, 3, 5]].tolist() == ["example.com/en/", "www.example.com/en/", "net/es/"] and got["rule"][[0, 1, 4, 6]].isna().all()
    assert got["host"][[0, 1, 2, 6]].tolist() == ["", "", "example.com", "b.net"] and got["path"][2] == "/en/x"
    learned = judge(df, (Rule("block", "evil.org", "/bad/"), Rule("allow", "fine.org", "/good/"))).toPandas().set_index("id")["verdict"]
    assert learned[len(urls) - 2] == "block" and learned[len(urls) - 1] == "allow"
    assert judge(df.where("false")).count() == 0


def test_verdict_query_on_odd_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "://", 2)], "page_id long, url string, host int")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert queries_op8.op8_url_reputation(spark, str(tmp_path)).count() == 3


def test_registered_domains(spark):
    from veilframe.llm.url_reputation import SUFFIXES, levels

    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.com:80": ("b.com", "com"), "u@x.org.": ("x.org", "org"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "": ("", ""), "localhost": ("localhost", "localhost")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = levels(df.host, SUFFIXES)
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == hosts


def test_hosts_under_a_long_suffix_share_no_domain(spark, tmp_path):
    urls = [f"http://www.bad{i % 3}.co.uk/x/{i}" for i in range(30)] + [f"http://a.good{i % 3}.co.uk:8080/y/{i}" for i in range(30)] + ["http://new.co.uk/", "http://b.good1.co.uk/", "http://z.bad1.co.uk/", "http://10.1.2.3/en/", "http://10.9.2.3/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    from veilframe.llm.url_reputation import judge

    from pyspark.sql import functions as F

    got = judge(df.withColumn("bad", (df.page_id < 30).cast("int")), (), outcome=F.when(F.col("page_id") < 60, F.col("page_id") < 30)).toPandas().set_index("id").verdict
    assert (got[:30] == "block").all() and (got[30:60] == "allow").all() and got[61] == "allow" and got[62] == "block"
    df.write.parquet(f"{tmp_path}/pages.parquet")
    pages = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pages)
    same_rows(queries_op8.op8_url_reputation(spark, str(tmp_path)), con.sql(queries_op8.ORACLE).df())
