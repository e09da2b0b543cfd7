import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs or longer rows, with columns that clash with the operators' own."""

    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        for name in ("score", "k", "size", "fp", "bucket", "digest", "target"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return make
