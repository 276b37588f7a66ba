import pytest

from tablefold.llm import queries  # noqa: F401


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    def docs(rows):
        more = [(i, t, "en", f"src{n % 3}" if n % 5 else None, len(t or ""), n, "x") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, score long, node string")
    return docs
