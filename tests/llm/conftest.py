"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import pytest

LONG = "word and another one here, " * 4000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and clashing column names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "s", 1, "q"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "s", 1, "q"),
        (2, None, "en", None, None, None),
        (3, "", None, "s", 0, "x"),
        (4, LONG, "en", "s", len(LONG), "x"),
        (None, "the quick brown fox jumps over the lazy dog near the river bank today", None, "s", 1, None),
        (5, "12 34 !!", "de", "s", 8, "y"),
        (6, " \n\t ", "de", "s", 4, "y"),
        (7, "der schnelle braune Fuchs springt über den faulen Hund am Ufer", "de", "s", 1, "y"),
    ]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string"
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
