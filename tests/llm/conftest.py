import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("words", T.StringType()), T.StructField("mark", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """(id, text) rows as documents with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "w", 7) for i, t in rows], SCHEMA)

    return make
