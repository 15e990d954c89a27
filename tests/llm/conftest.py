"""Edge-case rows shared by the tests: nulls, empty and long texts, repeats, ties and columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

TEXTS = [(0, "The quick brown fox\njumps over it all\n", "a"), (1, "The quick brown fox\njumps over it all\n", "b"),
         (2, None, "a"), (3, "", None), (4, " \t\r\n ", "a"), (5, "One\x0b two   THREE", "b"), (5, "One two THREE", "b"),
         (5, "One two THREE", "b"), (None, "One two THREE", "a"), (6, "É é ſ K ß", "a"), (7, "x" * 3000, "b"),
         (8, "word " * 2000, "a"), (9, "foo <|endoftext|> bar <s>", "b"), (10, "a  b c ▁ d▁ e", "a")]


@pytest.fixture()
def odd_docs(spark):
    """Columns that operators use inside come along with other contents."""
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string, source string")
    return docs.withColumns({c: F.lit("other") for c in ("id", "kept", "_id", "_row", "n", "tid", "score", "slot", "a",
                                                          "label", "keep_id", "block", "_line", "words")})


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
