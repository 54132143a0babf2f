import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size int, key string, score double, node long, comp long, part int, html string, rank int, id long, toxic int, share double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of documents from (doc_id, text, source, lang) rows, with columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, s, g, len(t or ""), 7, "k", 0.5, 1, 2, 3, "<p>", 4, 5, 1, 0.5) for i, t, s, g in rows], SCHEMA)

    return make


LONG = "word" * 3 + " " + " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, "a", "en"), (2, "", "a", None), (3, "one two", None, "en"), (4, "One  TWO", "b", "fr"), (5, LONG, "b", "en"), (5, LONG, "b", "en"),
    (6, LONG, "c", "en"), (None, "no id here at all, but six words", "c", "en"), (7, "é" * 300, "", "fr"), (8, " \t\n ", "a", "en"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
