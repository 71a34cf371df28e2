import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, key string, fp string, _k string, tokens string, y int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x", 1) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    long = "word " * 30_000 + "end"
    return [(1, "Hello there, write to a.b@example.com or +1 (555) 123-4567 now."), (2, None), (3, ""), (4, "   \n\t "), (5, long), (5, long),
            (None, "no key here at all"), (7, "a"), (8, "\U0001f600 ퟿ \x00 zero"), (9, "Hello there, write to a.b@example.com or +1 (555) 123-4567 now.")]
