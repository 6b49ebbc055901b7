import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(id, text[, source]) rows -> a documents table."""

    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Nulls in any column, empty and blank texts, ties and repeated rows.
HARD = [
    (1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"),
    (6, "a b c d e f g h i j k", None), (7, "A b  c d e\tf g h i j k", "c"), (None, "a b c d e f g h i j k", "c"),
    (8, "word " * 30_000, "c"), (9, "x" * 70_000, "d"), (10, "é ß 中 😀 '’   z", "d"),
]


@pytest.fixture(scope="session")
def hard(docs_of):
    return docs_of(HARD)


@pytest.fixture(scope="session")
def empty(docs_of, spark):
    return spark.createDataFrame([], SCHEMA)
