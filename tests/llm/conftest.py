import pytest

#: doc_id, text, lang, source, n_chars and a column whose name clashes with ones the operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, word string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [
        (1, "plain words in a row", "en", "a", 20, 7, "x"),
        (1, "plain words in a row", "en", "a", 20, 7, "x"),
        (2, "plain words in a row", "en", "b", 20, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, 0, ""),
        (5, " \n\t ", "en", "c", 4, 0, ""),
        (6, long, "en", "a", len(long), 1, "x"),
        (7, long, "en", "a", len(long), 1, "x"),
        (None, "no id here", "en", "a", 10, 1, "x"),
        (8, "été \U0001f600 ퟿ a b c", "fr", "b", 12, 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
