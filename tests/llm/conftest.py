import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text, lang, source, n_chars) plus a column whose name clashes with helper columns."""

    def make(rows):
        full = [(*r, *([None] * (4 - len(r))), len(r[1] or ""), "extra") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string")

    return make
