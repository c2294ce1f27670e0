import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, start int, kind string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and then it sleeps all day long in the warm sun"
    rows = [
        (1, prose, "en", "a", 90, 1, 1, "x"), (2, prose, "en", "b", 90, None, None, None), (3, None, None, None, None, 7, 7, "y"),
        (4, "", "en", "a", 0, 0, 0, ""), (5, " \t\n ", "en", None, 4, 0, 0, ""), (None, prose + " again", "en", "a", 1, 1, 1, "z"),
        (6, " ".join(f"w{i}" for i in range(30_000)), "en", "a", 1, 1, 1, "x"), (7, "one", "en", "a", 3, 1, 1, "x"),
        (7, "one", "en", "a", 3, 1, 1, "x"), (8, "Grüße, ñandú 漢字 😀 ok", "de", "é", 3, 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
