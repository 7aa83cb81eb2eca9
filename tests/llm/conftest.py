import pytest


@pytest.fixture
def docs_of(spark):
    """Rows (doc_id, text) as a table with further columns whose names clash with inner ones."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' AS lang", "1 AS n", "2 AS id", "'y' AS name", "3 AS rep", "'z' AS h", "4L AS k1", "5 AS mark")
    return make


PROSE = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon",
         "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"]
EDGE = [(1, PROSE[0]), (1, PROSE[0]), (2, None), (3, ""), (None, PROSE[1]), (None, None), (4, "word " * 3000), (5, "ü" * 500), (6, PROSE[0]), (7, " \n\t ")]
