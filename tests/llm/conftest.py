import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, `__digest` string, part int, size int, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, source]) with further columns whose names clash."""
    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, 1, "d", 2, 3, "k") for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    word = "lorem ipsum dolor sit amet consectetur "
    rows = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, "a b  c d\te f g h"), (4, "a b  c d\te f g h"), (None, "a b c d e f g h", None), (None, None, None), (5, " "),
            (6, word * 3000), (7, "x" * 200_000), (8, word * 3 + "End, of it."), (9, "Émile # $ 1,000 " + word), (9, "another text with the same id"), (10, word * 3000 + " tail")]
    return make_docs(rows)
