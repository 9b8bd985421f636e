"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registered
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query(spark, db, name):
    sql = registered.oracle_sql()[name]
    assert differences(spark, db, registered.queries()[name], sql, FOLDER) == []


def test_entry(spark):
    rows = registered.entry(spark)
    assert rows.count() == 14
    assert rows.filter("score >= 10").count() == 9
