import pytest

pytest.importorskip("avalista.llm")


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of rows (tuples) under a DDL schema, in three partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
