import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text[, lang, source])."""

    def make(rows):
        rows = [(r[0], r[1], *(r[2:] or (None, None)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Null and empty cells, a very long text, repeated rows, columns whose names clash with those of the operators."""
    long = "the quick brown fox " * 20_000
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "a"), (5, long, "en", "s"), (6, "é漢字 🙂 Ünï", None, "s")]
    rows = [(*r, *(None, None))[:4] for r in rows]
    return documents(rows).withColumns({c: F.lit("x") for c in ("hits", "fp", "score", "size", "rate", "n_tokens", "base", "spans", "component_id", "label")})
