"""Small document tables for the operators, and their odd cases."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, white space of all kinds, other scripts, a very long text, repeats."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
    return [None, "", "   \n\t", "Word", "a b c　d", "héé ß 中文 words \x1c here", long, "Word", "word", None]
