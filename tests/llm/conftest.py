import pytest

LONG = "alpha beta gamma delta " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns with names used inside."""
    rows = [(1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
            (4, LONG, "en", "b"), (4, LONG, "en", "b"), (None, "no id here at all", "en", "b"), (5, "  \n\n \t", "en", None),
            (6, "the quick brown fox jumps over the lazy dog again and again", "en", "b"), (6, "another text of the same id", "en", "b")]
    extra = [(*r, 1.5, "w", "word", 7) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, hash double, w string, word string, place int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
