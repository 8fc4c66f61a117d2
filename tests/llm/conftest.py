import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of ``(doc_id, text, source)`` as documents, with columns that clash with names the operators use inside."""

    def make(rows):
        made = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
        return made.selectExpr("*", "'x' AS node", "1 AS kind", "'y' AS u", "2 AS keep", "'z' AS component", "3 AS size")

    return make


WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}" for i in range(600)]


@pytest.fixture
def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = " ".join(WORDS[i * 37 % 600] for i in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog", "a"), (2, "The quick  brown fox jumps over the lazy dog", "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"),
        (6, long, "c"), (7, long, "c"), (8, "The quick brown fox jumps over the lazy dog", "a"), (8, "The quick brown fox jumps over the lazy dog", "a"), (9, "één ñandú 😀 über", None),
    ]
