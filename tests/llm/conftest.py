import pytest

from provenir.llm.common import ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, fp string, score double, keep string"

#: Nulls in every column, empty and long texts, ties, repeated rows, clashing column names.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 10, 1, "x", 0.5, "k"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 10, 1, "x", 0.5, "k"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 10, None, None, None, None),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None, None, None),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b", 3, None, None, None, None),
    (5, " \n\t ", None, "b", 3, None, None, None, None),
    (6, "12 34 !!! ---", "fr", None, 3, None, None, None, None),
    (7, "lorem ipsum dolor sit amet " * 20000, "en", "a", 9, None, None, None, None),
    (8, "<|endoftext|> and <|im_end|> é ﬁ 日本語 á don't  two  spaces", "en", "c", 9, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
