import pytest


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture
def documents(spark):
    return lambda rows: _documents(spark, [(i, t, None, s, None if t is None else len(t)) for i, t, s in rows])


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    long = "many words and then some more words " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (None, "no id here at all, none", "fr", None, 3), (4, long, "en", "s", len(long)), (5, "same text twice in a row here", "en", "s", 9), (5, "same text twice in a row here", "en", "s", 9), (6, "\U0001f642 12345 ▁ \x00 é", "xx", "", 1)]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return base.selectExpr("*", "'x' AS score", "1 AS leaks", "2 AS pieces", "3 AS decoded", "4 AS n_secrets", "5 AS host", "6 AS lang_pred", "7 AS component", "8 AS value", "9 AS word", "10 AS id")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
