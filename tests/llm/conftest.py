import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties and columns of clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t ", "en", None),
        (6, base.upper() + " sixteen", "en", "a"), (7, "word " * 30000, "en", "a"), (None, base, None, None), (8, "x", "en", "a"), (9, "x", "en", "a"), (10, "ein wort\nzwei wort", "de", "c"),
        (11, "\u00e9\u00e8 \u4e2d\u6587 \U0001f600", "fr", "c"), (12, "12 34 ... 56", "en", "c"), (13, base + "\n" + base, "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("id", "row", "n", "pos", "key", "word", "gone", "at", "hash", "site"):
        df = df.withColumn(name, df["lang"])
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
