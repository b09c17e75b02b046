"""Categories, labels and the schemas of every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# Span categories in label order, and tags inside a category.
CATEGORIES = ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret")
TAGS = ("B", "I", "E", "S")
N_LABELS = 1 + len(CATEGORIES) * len(TAGS)
FORBIDDEN = -1e9

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
TOKEN = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("bs", T.IntegerType()), T.StructField("be", T.IntegerType())])
SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toks", T.ArrayType(TOKEN))])
SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
LOGPROBS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lp", T.ArrayType(T.ArrayType(T.FloatType())))])


def label_of(category: int, tag: int) -> int:
    """Label 0 is outside; others count tags inside categories."""
    return 1 + category * len(TAGS) + tag


def label_name(label: int) -> str:
    return "O" if label == 0 else f"{TAGS[(label - 1) % 4]}-{CATEGORIES[(label - 1) // 4]}"
