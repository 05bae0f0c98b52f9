import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Rows to a table like documents, with one extra column whose name clashes with an operator's."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make
