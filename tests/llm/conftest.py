from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, host string, n long"


def table(spark, texts, **more):
    """A documents table of ``texts`` with extra columns whose names clash with those of operators."""
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), 7, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [
        (0, "", "en", "a", 0, 1, "h", 1), (1, None, None, None, None, None, None, None), (None, "one two three", "en", "a", 13, 1, "h", 1),
        (3, "same words here " * 40, "en", "a", 640, 1, "h", 1), (3, "same words here " * 40, "en", "a", 640, 1, "h", 1), (4, "same words here " * 40, "fr", "b", 640, 1, "h", 1),
        (5, " \n\t   éİſ\U0001f600\x00 end", "de", "", 9, 1, "h", 1), (6, "long " * 60_000 + "x" * 50_000, "en", "b", 350_000, 1, "h", 1),
        (7, "tail <|endoftext|> text՘ don't", "en", "b", 5, 1, "h", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
