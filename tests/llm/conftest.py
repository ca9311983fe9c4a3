import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, row string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties and columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "   \n\t ", "en", "a", 6), (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)),
        (6, "one two three", "fr", "b", 13), (6, "one two three", "fr", "b", 13), (7, "ONE two  Three", "fr", None, 14), (None, "no id here at all, token = abcdef123", "de", "c", 3),
        (8, "12345 %% !!", "en", "c", 11), (9, "ﬁne Straße É é", "de", "c", 9), (10, long + " more", "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
