import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


ODD = [
    (1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "Same text of words here.", "x"), (5, "Same text of words here.", "x"),
    (5, "Same text of words here.", "x"), (None, "no id at all", "x"), (7, "naïve ÉTÉ ▁ straße  ﬁ 日本語\n\ttab <|endoftext|> <s>", None),
    (8, "word " * 30_000, "x"), (9, "1" * 20_000 + "@" + "a" * 20_000, "x"), (10, "\n\n\n", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    rows = [(a, b, c, "q", 3, 4) for a, b, c in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, uid string, share int, h int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
