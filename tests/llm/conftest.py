import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Documents from texts, or from (doc_id, text, lang, source) tuples."""
    def make(*rows):
        full = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(rows)]
        full = [(*row, *("en", "a")[len(row) - 2:]) if len(row) < 4 else row for row in full]
        return spark.createDataFrame([(*row, len(row[1] or "")) for row in full], DOCUMENTS)
    return make


#: Nulls, empty, repeated rows, ties and a long text, in one table.
HARD = [(1, None, "en", "a"), (2, "", "en", None), (None, "no id here", None, "b"), (3, "same text", "en", "a"),
        (3, "same text", "en", "a"), (4, "same text", "de", "a"), (5, "x" * 300_000, "en", "b"), (6, "word " * 40_000, "en", "b"),
        (7, " \t\n", None, None)]
