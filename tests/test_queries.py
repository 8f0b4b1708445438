"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import database, differences
from helpers import FOLDER

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, folder, con, name):
    result = entry.queries()[name](spark, folder).toPandas()
    if name in SQL:
        assert differences(result, con.execute(SQL[name]).df()) is None
    else:
        assert len(result)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
