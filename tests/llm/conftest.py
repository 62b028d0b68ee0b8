"""Small document tables with the awkward cases that every corpus operator must take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    long = "word " * 60_000 + "end"
    rows = [
        (1, "the same text here and there", "en", "a", 1),
        (2, "the same text here and there", None, None, None),
        (2, "the same text here and there", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", None, "a", 0),
        (5, "   \n\t ", "en", None, 3),
        (6, long, "en", "a", None),
        (None, "a text without an id", "de", "b", 1),
        (7, "x" * 5000, "fr", "b", 5000),
        (8, "日本語のテキスト 😀 é́ ﬁ", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["id", "key", "fp", "sha", "node", "keep_id", "group_size", "kept", "lost_id", "lost_sha", "shard", "size", "score", "spans", "label", "mark", "words", "n_tokens", "component_id", "row_id"]
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in extra})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("1 = 0")
