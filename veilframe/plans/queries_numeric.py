"""Queries over vectors: the scorer's arithmetic on the embeddings table (64 dimensions as activations or logits)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import dense

ROUND = 6


def _vectors(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", (vec if n is None else F.slice(vec, 1, n)).alias("vec"))


def _long(df: DataFrame, value: Column) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(value).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", ROUND).alias("x"))


def argmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir, 33).select("vec_id", arrays.argmax(F.col("vec")).alias("best"))


def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir, 33), arrays.log_softmax(F.col("vec")))


def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir), arrays.rms_norm(F.col("vec")))


def swiglu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_vectors(spark, sf_dir), arrays.swiglu(F.transform("vec", lambda x: x * 20.0)))


def _routed(spark: SparkSession, sf_dir: str, skip_beta: float = 0.0) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.top_experts(F.transform("vec", lambda x: x * 4.0), 4, skip_beta)).alias("slot", "s"))
    return rows.select("vec_id", "slot", "s.expert", "s.gate")


def router_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).withColumn("gate", F.round("gate", ROUND))


def router_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, 0.8).withColumn("gate", F.round("gate", ROUND))


def expert_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dispatch(_routed(spark, sf_dir)).withColumn("weight", F.round("weight", ROUND))


def moe_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir).join(_vectors(spark, sf_dir), "vec_id").select(F.col("vec_id").alias("pos"), "slot", F.posexplode(F.transform("vec", lambda x: x * F.col("gate") * (F.col("expert") + 1))).alias("i", "y"))
    return dense.reduce_slots(routed).select(F.col("pos").alias("vec_id"), "i", F.round("y", ROUND).alias("x"))


def expert_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both products of the chosen experts with weights from a formula: 64 experts, 64 inputs, 8 hidden values."""
    e = F.col("expert")
    row = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)
    weights = spark.range(64).select(F.col("id").cast("int").alias("expert")).select(
        "expert",
        row(16, lambda o: row(64, lambda i: F.cos(e + 3 * o + 5 * i) / 8)).alias("w1"), row(16, lambda o: F.sin(e + o) / 4).alias("b1"),
        row(64, lambda o: row(8, lambda i: F.sin(2 * e + o + 7 * i) / 2)).alias("w2"), row(64, lambda o: F.cos(e - o) / 4).alias("b2"),
    )
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("pos"), F.transform("vec", lambda x: x * 40.0).alias("vec"))
    parts = dense.experts(_routed(spark, sf_dir).withColumnRenamed("vec_id", "pos").join(vectors, "pos"), weights)
    return dense.reduce_slots(parts).select(F.col("pos").alias("vec_id"), "i", F.round("y", ROUND).alias("x"))


def rope_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos, sin = dense.rope_angles(F.col("vec_id").cast("double"), 64)
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(cos.alias("c"), sin.alias("s"))).alias("i", "z"))
    return rows.select("vec_id", "i", F.round("z.c", ROUND).alias("c"), F.round("z.s", ROUND).alias("s"))


def rope_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos, sin = dense.rope_angles(F.col("vec_id").cast("double"), 64)
    rows = _vectors(spark, sf_dir).withColumn("cos", cos).withColumn("sin", sin)
    return _long(rows, arrays.rotate_pairs(F.col("vec"), F.col("cos"), F.col("sin")))


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    got = dense.gather(rows.select(F.col("vec_id").alias("pos"), F.col("label").cast("long").alias("id")), rows.select(F.col("vec_id").alias("id"), "vec"))
    return got.select(F.col("pos").alias("vec_id"), F.col("id").alias("token"), F.round(F.get("vec", F.lit(0)), ROUND).alias("x0"), F.round(F.get("vec", F.lit(63)), ROUND).alias("x63"))


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product with the ten class means as weight rows."""
    rows = _vectors(spark, sf_dir)
    means = rows.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("w"))
    out = dense.project(rows.select(F.col("vec_id").alias("pos"), "vec"), means.select(F.col("label").alias("o"), "i", "w"))
    return out.select(F.col("pos").alias("vec_id"), "o", F.round("y", ROUND).alias("y"))


def band_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    rows = v.select(F.col("vec_id").alias("pos"), F.slice("vec", 1, 16).alias("q"), F.slice("vec", 17, 16).alias("k"), F.slice("vec", 33, 16).alias("v"))
    out = dense.band_attention(rows, 8, 1.0, 0.25)
    return out.select(F.col("pos").alias("vec_id"), "i", F.round("y", ROUND).alias("x"))


def label_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir, 33).select(F.col("label").alias("doc"), F.col("vec_id").alias("pos"), arrays.argmax(F.col("vec")).alias("label"))
    return dense.label_islands(rows)


QUERIES = {f.__name__: f for f in (argmax_labels, log_softmax, rms_norm, swiglu, router_topk, router_skip, expert_dispatch, expert_mlp, moe_reduce, rope_tables, rope_apply, embedding_lookup, projection, band_attention, label_islands)}

_E = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_U = f"SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(v) AS x FROM ({_E})"
_ROUTED = f"""
  r AS (SELECT vec_id, i AS expert, 4 * x AS g, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS slot FROM ({_U})),
  k AS (SELECT *, exp(g - max(g) OVER (PARTITION BY vec_id)) AS w FROM r WHERE slot < 4),
  routed AS (SELECT vec_id, slot, expert, w / sum(w) OVER (PARTITION BY vec_id) AS gate FROM k)"""
_LOW, _HIGH = (32 * math.log(4096 / (b * 2 * math.pi)) / math.log(150000) for b in (32.0, 1.0))
_ROPE = f"""
  f AS (SELECT i, 1 / pow(150000.0, 2.0 * i / 64) AS ex, 1 - least(greatest((i - {_LOW!r}) / {_HIGH - _LOW!r}, 0), 1) AS mask FROM range(0, 32) t(i)),
  a AS (SELECT vec_id, i, vec_id * (ex / 32 * (1 - mask) + ex * mask) AS angle FROM embeddings, f),
  rope AS (SELECT vec_id, i, cos(angle) * (0.1 * ln(32) + 1) AS c, sin(angle) * (0.1 * ln(32) + 1) AS s FROM a)"""

ORACLES = {
    "argmax_labels": "SELECT vec_id, (list_position(embedding[1:33], list_max(embedding[1:33])) - 1)::INT AS best FROM embeddings",
    "log_softmax": f"WITH u AS ({_U}), w AS (SELECT * FROM u WHERE i < 33), m AS (SELECT vec_id, max(x) AS m FROM w GROUP BY 1), n AS (SELECT vec_id, any_value(m) + ln(sum(exp(x - m))) AS z FROM w JOIN m USING (vec_id) GROUP BY 1) SELECT vec_id, i::INT AS i, round(x - z, {ROUND}) AS x FROM w JOIN n USING (vec_id)",
    "rms_norm": f"WITH u AS ({_U}), n AS (SELECT vec_id, sqrt(sum(x * x) / 64 + 1e-5) AS r FROM u GROUP BY 1) SELECT vec_id, i::INT AS i, round(x / r, {ROUND}) AS x FROM u JOIN n USING (vec_id)",
    "swiglu": f"WITH u AS ({_U}) SELECT a.vec_id, a.i::INT AS i, round(least(20 * a.x, 7) / (1 + exp(-1.702 * least(20 * a.x, 7))) * (greatest(least(20 * b.x, 7), -7) + 1), {ROUND}) AS x FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.i = a.i + 32",
    "router_topk": f"WITH {_ROUTED} SELECT vec_id, slot::INT AS slot, expert::INT AS expert, round(gate, {ROUND}) AS gate FROM routed",
    "router_skip": f"WITH {_ROUTED}, c AS (SELECT *, min((gate >= 0.8 * first_gate)::INT) OVER (PARTITION BY vec_id ORDER BY slot) AS keep FROM (SELECT *, max(gate) OVER (PARTITION BY vec_id) AS first_gate FROM routed)) SELECT vec_id, slot::INT AS slot, expert::INT AS expert, round(gate / sum(gate) OVER (PARTITION BY vec_id), {ROUND}) AS gate FROM c WHERE keep = 1",
    "expert_dispatch": f"WITH {_ROUTED} SELECT expert::INT AS expert, count(*) AS tokens, ceil(count(*) / 16.0)::BIGINT AS chunks, round(sum(gate), {ROUND}) AS weight FROM routed GROUP BY expert",
    "moe_reduce": f"WITH {_ROUTED} SELECT vec_id, i::INT AS i, round(sum(x * gate * (expert + 1)), {ROUND}) AS x FROM routed JOIN ({_U}) USING (vec_id) GROUP BY ALL",
    "expert_mlp": f"""WITH {_ROUTED}, u AS ({_U}),
        h AS (SELECT vec_id, slot, expert, gate, o, sum(40 * x * cos(expert + 3 * o + 5 * i) / 8) + any_value(sin(expert + o) / 4) AS h FROM routed JOIN u USING (vec_id), range(0, 16) t(o) GROUP BY vec_id, slot, expert, gate, o),
        a AS (SELECT g.vec_id, g.slot, g.expert, g.gate, g.o AS j, least(g.h, 7) / (1 + exp(-1.702 * least(g.h, 7))) * (greatest(least(l.h, 7), -7) + 1) AS a FROM h g JOIN h l ON l.vec_id = g.vec_id AND l.slot = g.slot AND l.o = g.o + 8),
        y AS (SELECT vec_id, slot, o, gate * (sum(a * sin(2 * expert + o + 7 * j) / 2) + any_value(cos(expert - o) / 4)) AS y FROM a, range(0, 64) t(o) GROUP BY vec_id, slot, o, gate, expert)
        SELECT vec_id, o::INT AS i, round(sum(y), {ROUND}) AS x FROM y GROUP BY vec_id, o""",
    "rope_tables": f"WITH {_ROPE} SELECT vec_id, i::INT AS i, round(c, {ROUND}) AS c, round(s, {ROUND}) AS s FROM rope",
    "rope_apply": f"WITH {_ROPE}, u AS ({_U}) SELECT u.vec_id, u.i::INT AS i, round(CASE WHEN u.i % 2 = 0 THEN u.x * c - o.x * s ELSE u.x * c + o.x * s END, {ROUND}) AS x FROM u JOIN u o ON o.vec_id = u.vec_id AND o.i = xor(u.i, 1) JOIN rope ON rope.vec_id = u.vec_id AND rope.i = u.i // 2",
    "embedding_lookup": f"SELECT a.vec_id, a.label::BIGINT AS token, round(b.embedding[1]::DOUBLE, {ROUND}) AS x0, round(b.embedding[64]::DOUBLE, {ROUND}) AS x63 FROM embeddings a JOIN embeddings b ON b.vec_id = a.label",
    "projection": f"WITH u AS ({_U}), w AS (SELECT label AS o, i, avg(x) AS w FROM u GROUP BY ALL) SELECT vec_id, o, round(sum(x * w), {ROUND}) AS y FROM u JOIN w USING (i) GROUP BY vec_id, o",
    "band_attention": f"""WITH u AS ({_U}),
        p AS (SELECT a.vec_id AS t, b.vec_id AS j, sum(a.x * b.x) AS s FROM u a JOIN u b ON abs(a.vec_id - b.vec_id) <= 8 AND a.i < 16 AND b.i = a.i + 16 GROUP BY ALL),
        m AS (SELECT t, greatest(max(s), 0.25) AS m FROM p GROUP BY t),
        e AS (SELECT t, j, exp(s - m) AS e, m FROM p JOIN m USING (t)),
        d AS (SELECT t, sum(e) + exp(0.25 - any_value(m)) AS d FROM e GROUP BY t)
        SELECT t AS vec_id, (i - 32)::INT AS i, round(sum(e * x) / any_value(d), {ROUND}) AS x FROM e JOIN d USING (t) JOIN u ON u.vec_id = j AND i BETWEEN 32 AND 47 GROUP BY t, i""",
    "label_islands": """WITH l AS (SELECT label AS doc, vec_id AS pos, list_position(embedding[1:33], list_max(embedding[1:33])) - 1 AS lab FROM embeddings),
        c AS (SELECT *, CASE WHEN lab > 0 THEN (lab - 1) // 4 END AS cat, CASE WHEN lab > 0 THEN (lab - 1) % 4 END AS tag FROM l),
        o AS (SELECT *, lag(cat) OVER w AS pc, lag(tag) OVER w AS pt FROM c WINDOW w AS (PARTITION BY doc ORDER BY pos)),
        s AS (SELECT *, CASE WHEN cat IS NULL THEN 0 WHEN tag IN (0, 3) OR pc IS NULL OR pt > 1 OR pc <> cat THEN 1 ELSE 0 END AS opens FROM o),
        r AS (SELECT *, sum(opens) OVER (PARTITION BY doc ORDER BY pos) AS run FROM s)
        SELECT doc, any_value(cat)::INT AS category, min(pos) AS first, max(pos) AS last FROM r WHERE cat IS NOT NULL GROUP BY doc, run""",
}
