import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Make ``documents``-like tables, with a clashing extra column."""

    def make(rows):
        schema = "doc_id long, text string, key string, th double, h int"
        return spark.createDataFrame([(i, t, "x", 0.5, None) for i, t in rows], schema)

    return make
