import pytest

import __spark_entry__ as entry
from tests.oracle import both, connection
from tidelog.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    columns, names, got, want = both(spark, con, entry.queries()[name], ORACLE_SQL[name], SF)
    assert columns == names
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
