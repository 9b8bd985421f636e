import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows and a schema, over a few partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
