"""Small documents tables with every odd case, and the session's tables."""

import pytest
from odd_rows import CLASHES, ROWS, SCHEMA, SMALL
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, wordless and long texts, equal texts, repeated rows, and extra columns whose names clash."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
