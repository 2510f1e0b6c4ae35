from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Every awkward row: nulls, empty and long texts, ties, repeats, and columns with clashing names."""
    words = "the quick brown fox jumps over a lazy dog while Peter writes to pete@example.org about 10.0.0.1 and"
    rows = [
        (1, words, "en", 7), (2, words, "en", 7), (2, words, "en", 7), (3, None, None, None), (4, "", "en", 0), (None, words + " more", "en", 1),
        (5, " \n\t ", "de", 1), (6, "x " * 40_000 + "end", "en", 2), (7, "ünïcödé ▁▁ 日本語 🙂 " * 30, "fr", 3), (8, "-" * 3000, None, 4), (9, "1234567", "en", 5),
        (10, words.upper(), "en", 6), (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int").selectExpr("*", "doc_id as component_id", "text as ids", "lang as bytes")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
