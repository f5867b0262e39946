from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark):
    """Documents with two columns that clash with names the operators use."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"
        full = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    return [
        (1, "alpha beta gamma delta", "a"),
        (1, "alpha beta gamma delta", "a"),
        (2, None, None),
        (3, "", "b"),
        (None, "alpha beta gamma delta", None),
        (4, "  \t\n ", ""),
        (5, "word " * 30_000, "a"),
        (6, "Ünï cödé   text 😀 end", "c"),
    ]
