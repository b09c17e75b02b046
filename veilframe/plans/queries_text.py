"""Queries over text: lines, pretokens, offsets, classes, trimming, escaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pretokens import byte_ranges, pretokens, sections
from ..functions.spans import json_escaped, placeholder, trimmed
from ..functions.unicode_classes import CLASSES, count_class
from ..operators.partitioning import spread
from ..schema import CATEGORIES
from ..sources import readers

# The same patterns for an engine without lookahead: a mark is set before the last white space of each run that
# precedes text, and taken out again.
_WS, _NWS = r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"
_U, _D = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]"
_SFX = r"(?:''[sS]|''[tT]|''[rR][eE]|''[vV][eE]|''[mM]|''[lL][lL]|''[dD])?"
_MARK = r"\x{1}?"
_MARKED = "|".join(
    [
        rf"{_MARK}[^\r\n\p{{L}}\p{{N}}\x{{1}}]?{_U}*{_D}+{_SFX}",
        rf"{_MARK}[^\r\n\p{{L}}\p{{N}}\x{{1}}]?{_U}+{_D}*{_SFX}",
        r"\p{N}{1,3}",
        rf"{_MARK} ?[^\t-\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}\x{{1}}]+[\r\n/]*{_MARK}[\r\n/]*",
        rf"{_WS}*{_MARK}[\r\n]+",
        rf"{_MARK}{_WS}+",
    ]
)


def pretokens_sql(text: str) -> str:
    """DuckDB list of pretokens of an expression."""
    return f"list_transform(regexp_extract_all(regexp_replace({text}, '({_WS})({_NWS})', chr(1) || '\\1\\2', 'g'), '{_MARKED}'), lambda x: replace(x, chr(1), ''))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.doc_lines(_docs(spark, sf_dir))


def pretoken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(pretokens(F.col("text"))).alias("pos", "piece"))


def pretoken_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tokens import bpe_tokens

    toks = bpe_tokens(_docs(spark, sf_dir), None)
    return toks.select("doc_id", F.posexplode("toks").alias("pos", "t")).select("doc_id", "pos", "t.bs", "t.be")


def pretoken_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges by column functions, on the short texts."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", F.posexplode(byte_ranges(pretokens(F.col("text")))).alias("pos", "t")).select("item_id", "pos", "t.piece", "t.bs", "t.be")


def codepoint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *[count_class(F.col("text"), c).alias(n) for n, c in CLASSES.items()])


def special_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("<|endoftext|>")), F.lit("\n"), F.lit("<|endofprompt|>"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(sections(text)).alias("section", "s")).select("doc_id", "section", "s.piece", F.coalesce("s.literal", F.lit("")).alias("literal"))


def trim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("pos", "part"))
    return rows.select("doc_id", "pos", F.octet_length("part").alias("n"), trimmed(F.col("part"), F.lit(0), F.octet_length("part")).alias("t")).select("doc_id", "pos", F.col("t.start").alias("bs"), F.greatest("t.start", "t.end").alias("be"))


def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", json_escaped(F.col("text")).alias("escaped"))


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return rows.select("vec_id", placeholder(F.get(names, F.col("label") % len(CATEGORIES))).alias("mark"))


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and size of each text as stored."""
    return _docs(spark, sf_dir).select("doc_id", F.is_valid_utf8("text").alias("valid"), F.octet_length("text").alias("n_bytes"))


QUERIES = {
    "doc_lines": doc_lines,
    "pretokens": pretoken_rows,
    "pretoken_offsets": pretoken_offsets,
    "pretoken_ranges": pretoken_ranges,
    "codepoint_classes": codepoint_classes,
    "special_sections": special_sections,
    "trim_spans": trim_spans,
    "json_strings": json_strings,
    "placeholders": placeholders,
    "whole_texts": whole_texts,
}

_TRIM = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ESCAPED = "replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
for _c in range(1, 0x20):
    _ESCAPED = f"replace({_ESCAPED}, chr({_c}), chr(92) || 'u{_c:04x}')"

ORACLES = {
    "doc_lines": """
        WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
             q AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM p)
        SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS line_no, unnest(ls) AS line FROM q""",
    "pretokens": f"""
        WITH p AS (SELECT doc_id, {pretokens_sql('text')} AS ps FROM documents)
        SELECT doc_id, (unnest(range(1, len(ps) + 1)) - 1)::INT AS pos, unnest(ps) AS piece FROM p""",
    "pretoken_offsets": f"""
        WITH p AS (SELECT doc_id, {pretokens_sql('text')} AS ps FROM documents),
             u AS (SELECT doc_id, (unnest(range(1, len(ps) + 1)) - 1)::INT AS pos, unnest(ps) AS piece FROM p),
             s AS (SELECT doc_id, pos, octet_length(encode(piece)) AS n, sum(octet_length(encode(piece))) OVER (PARTITION BY doc_id ORDER BY pos) AS be FROM u)
        SELECT doc_id, pos, (be - n)::INT AS bs, be::INT AS be FROM s""",
    "pretoken_ranges": f"""
        WITH p AS (SELECT item_id, {pretokens_sql('text')} AS ps FROM benchmark),
             u AS (SELECT item_id, (unnest(range(1, len(ps) + 1)) - 1)::INT AS pos, unnest(ps) AS piece FROM p),
             s AS (SELECT item_id, pos, piece, octet_length(encode(piece)) AS n, sum(octet_length(encode(piece))) OVER (PARTITION BY item_id ORDER BY pos) AS be FROM u)
        SELECT item_id, pos, piece, (be - n)::INT AS bs, be::INT AS be FROM s""",
    "codepoint_classes": "SELECT doc_id, " + ", ".join(rf"len(regexp_extract_all(text, '{c}'))::INT AS {n}" for n, c in CLASSES.items()) + " FROM documents",
    "special_sections": r"""
        WITH t AS (SELECT doc_id, replace(replace(text, '. ', '<|endoftext|>'), chr(10), '<|endofprompt|>') AS x FROM documents),
             p AS (SELECT doc_id, string_split_regex(x, '<\|endoftext\|>|<\|endofprompt\|>') AS ps, regexp_extract_all(x, '<\|endoftext\|>|<\|endofprompt\|>') AS ls FROM t)
        SELECT doc_id, (unnest(range(1, len(ps) + 1)) - 1)::INT AS section, unnest(ps) AS piece, unnest(list_concat(ls, [''])) AS literal FROM p""",
    "trim_spans": f"""
        WITH p AS (SELECT doc_id, string_split(text, '.') AS ps FROM documents),
             u AS (SELECT doc_id, (unnest(range(1, len(ps) + 1)) - 1)::INT AS pos, unnest(ps) AS x FROM p),
             l AS (SELECT *, octet_length(encode(x)) - octet_length(encode(regexp_replace(x, '^{_TRIM}+', ''))) AS bs FROM u)
        SELECT doc_id, pos, bs::INT AS bs, greatest(bs, octet_length(encode(regexp_replace(x, '{_TRIM}+$', ''))))::INT AS be FROM l""",
    "json_strings": f"SELECT conv_id, turn, {_ESCAPED} AS escaped FROM conversations",
    "placeholders": "SELECT vec_id, '<' || upper(['account_number','private_address','private_date','private_email','private_person','private_phone','private_url','secret'][1 + label % 8]) || '>' AS mark FROM embeddings",
    "whole_texts": "SELECT doc_id, text IS NOT NULL AS valid, octet_length(encode(text))::INT AS n_bytes FROM documents",
}
