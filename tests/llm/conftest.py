from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, blank and very long texts, repeated rows, ties, and columns with names that operators use."""
    long_text = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [
        (1, "The plain text of one document, with words enough to be kept by all the rules.", "en", "a", 3),
        (1, "The plain text of one document, with words enough to be kept by all the rules.", "en", "a", 3),
        (2, None, "en", "a", 0), (None, "no id but text", None, None, 1), (None, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "de", "b", 4),
        (5, long_text, "en", "b", len(long_text)), (6, "\x00 ퟿ é ñ 漢字 🙂", "fr", "c", 9), (7, "x", None, "c", 1), (8, "x", "es", "c", 1),
        (-9, "a b c", "en", "", 5),
    ]
    clash = "*", "1 size", "2 label", "3 fp", "4 shard", "5 score", "6 seq", "'k' key", "7 words", "8 n_words"
    return spark.createDataFrame(rows, DOCS).selectExpr(*clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0), (5, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
