import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture
def docs(spark):
    """A function from (id, text, source) rows to a documents table with a column more."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x") for r in rows], DOC)

    return make
