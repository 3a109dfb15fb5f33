import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, source); more columns may follow, with a schema of their own."""

    def make(rows, more=(), schema=""):
        full = [(i, t, "en", s, None if t is None else len(t), *more) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS + (", " + schema if schema else "")).repartition(3)

    return make


@pytest.fixture
def some_texts():
    """Texts of all awkward kinds, with copies."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(i * i + i // 7) % 10] + str(i % 13) for i in range(6000))
    return [
        (1, None, "a"), (2, "", "a"), (3, "  \t\n", None), (4, "one", "a"), (5, "one two three four", "b"),
        (6, long, "b"), (7, long + " end", "b"), (8, "Alpha, beta. alpha; BETA\n\nx", None), (9, "Alpha, beta. alpha; BETA\n\nx", "c"),
        (9, "Alpha, beta. alpha; BETA\n\nx", "c"), (None, "a row without an id", "c"), (10, "same words " * 40, "c"),
        (11, "same words " * 40 + "more", "c"), (12, "ünïcödé ﬁ <|endoftext|> ç", "a"),
    ]
