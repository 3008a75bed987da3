import pytest

KIND = "doc_id long, text string, lang string, n_words long, row_id string, spans string, marks long, `class` string, lo int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) with columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, 1, "x", "y", None, "z", 3) for i, t in rows], KIND)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and blank texts, ties, repeated rows and a long text."""
    long = " ".join(f"w{i}x" for i in range(9000))
    rows = [(1, None), (None, "alpha beta"), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (4, "other words here"), (5, long), (6, "É ß 日本 it's <|x 5.5€\x0b"), (None, None)]
    return docs_of(rows)
