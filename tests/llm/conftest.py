from __future__ import annotations

import pytest

LONG = "alpha beta gamma delta. " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns whose names clash with those inside the operators."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "  \n\t ", "en", "a", 5),
        (4, LONG, "en", "a", len(LONG)),
        (5, "One short line.", "en", "b", 15),
        (5, "One short line.", "en", "b", 15),
        (6, "One short line.", "de", None, 15),
        (None, "No id here, only a text.", "en", "b", 24),
        (7, "Ünïcode ßtraße — “quotes” 😀 and\u0085more", "de", "b", 30),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = {"node": F.lit(1), "bucket": F.lit("x"), "shard": F.lit(99), "slot": F.lit(0), "size": F.lit(3), "score": F.lit(0.1), "item": F.lit(1), "n_words": F.lit(0), "kept": F.lit(True), "component": F.lit(4), "position": F.lit(0.5), "target": F.lit(1)}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture()
def tables(spark, tmp_path):
    """Write named DataFrames as <name>.parquet and return the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
