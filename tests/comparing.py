"""Comparison of results."""


def same_rows(spark_df, duck_df):
    """Compare results by sorted columns and rows."""
    import pandas as pd

    got = spark_df.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(duck_df.columns)
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(duck_df), check_dtype=False)
