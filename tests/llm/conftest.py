import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, size int, key string, start int, digest string, fp int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with further columns whose names clash with the operators' own."""

    def make(*rows):
        """rows: (doc_id, text, lang, source)"""
        return spark.createDataFrame([(i, t, lang, s, 0 if t is None else len(t), "x", 1, "k", 2, "d", 3) for i, t, lang, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and blank texts, a very long text, repeated rows, ties, null ids."""
    long = "word " * 300_000 + "a.b@example.com"
    return [(1, None, None, None), (2, "", "en", None), (3, " \n\t", None, "b"), (4, "Same Text here", "en", "a"), (5, "same text HERE", "en", "a"), (5, "same text HERE", "en", "a"), (6, long, "en", "a"), (7, "ÄÉ ß 日本", "de", "b"), (None, "Same Text here", None, None), (8, "12345 !!", None, "a")]
