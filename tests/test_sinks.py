"""Dumps, lines and counts."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from comparing import same_rows
from pyspark.sql import functions as F

from veilframe.operators.tokens import bpe_tokens
from veilframe.plans.queries_pipeline import ORACLES, QUERIES
from veilframe.sources.sinks import logprob_dump, observed, token_dump, write_lines


def test_token_dump_and_counts(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, ""), (3, None)], "doc_id long, text string")
    tokens, seen = observed(bpe_tokens(docs, None))
    assert token_dump(tokens).count() == 2
    tokens.write.format("noop").mode("overwrite").save()
    assert seen.get["docs"] == 3


def test_logprob_lines(spark):
    df = spark.createDataFrame([(1, [[-0.5, -1.25], [-2.0, -0.0000004]])], "doc_id long, lp array<array<float>>")
    assert [r["line"] for r in logprob_dump(df).orderBy("t").collect()] == ["-0.500000 -1.250000", "-2.000000 -0.000000"]


def test_numbers_are_those_of_printf(spark, tmp_path):  # F1
    rng = np.random.default_rng(5)
    ties = (2 * rng.integers(-300, 300, (60, 64)) + 1) / 128  # seven decimals, the last one a 5
    rows = np.r_[ties, rng.standard_normal((60, 64))].astype(np.float32)
    rows[2:5, :4] = [[np.nan, np.inf, -np.inf, -0.0], [-4e-7, 4e-7, 5e-7, -5e-7], [1e9, -1e12, 0.0, 1e-30]]
    ids = pa.array(np.r_[0:60, 3_000_000_000:3_000_000_060])
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array([None, [None, *rows[1, 1:]], *rows[2:]], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    same_rows(QUERIES["logprob_lines"](spark, str(tmp_path)), duck.sql(ORACLES["logprob_lines"]).df())
    double = [0.1234565, 0.1234575, -2.5e-7, 1.0000005]
    assert logprob_dump(spark.createDataFrame([(1, [double])], "doc_id long, lp array<array<double>>")).first()["line"] == " ".join(f"{x:.6f}" for x in double)


def test_one_line_per_record(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n"), (2, None), (3, "b")], "i int, t string").coalesce(1).orderBy("i")
    write_lines(df, str(tmp_path / "out"), "t")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data == b"a\n\n\nb\n"
    assert spark.read.text(str(tmp_path / "out")).agg(F.count("*")).first()[0] == 4
