import pytest

LONG = "wörd " * 30_000
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, idx int, node string, word string, "
          "part string, start int, grp string, key string")


def document(doc_id, text, lang="en", source="a"):
    """A document with extra columns whose names the operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7, 7, "x", "x", "x", 7, "x", "x")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [
        document(1, "one two three four five six"), document(2, "one two three four five six"), document(3, " one\ttwo three four five six "),
        document(4, None), document(5, ""), document(6, " \n\t "), document(7, LONG, None, None), document(8, LONG + "end", "de", "b"),
        document(9, "Hi"), document(9, "Hi"), document(10, "hi ☃ é", None, "b"), (None,) * 13, document(11, "one two THREE four five six"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"
