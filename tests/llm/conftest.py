import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) or fuller rows."""

    def build(rows):
        full = [tuple(r) + ("en", "s", len(r[1] or ""))[len(r) - 2:] for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    """The documents of the smallest scale, and the same as Python rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, df.collect()
