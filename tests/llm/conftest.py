import random

import pytest

#: Rows that every operator must take: nulls, empties, ties, repeats, odd characters, a long text.
ODD = [None, "", " ", "\n\n", "a", "A b", "a B", "é", "日本語 テキスト", "x" * 5000, "the cat sat on the mat " * 400, "😀 don't  stop\t\x0b now  ", "1 22 333", "same text here", "same text here"]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD)


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text, lang, source) with odd texts, and columns whose names operators might use themselves."""
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    return df.selectExpr("doc_id", "text", "lang", "source", "doc_id AS id", "1 AS n", "'x' AS kept", "'y' AS component", "2.5 AS score", "'z' AS bucket", "array(1) AS spans", "'w' AS repetition", "'v' AS pii")


@pytest.fixture
def rng():
    return random.Random(7)
