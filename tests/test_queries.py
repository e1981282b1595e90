"""Every named query with SQL, next to DuckDB on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = queries()[name](spark, sf).toPandas()
    problem = difference(got, duck.execute(SQL[name]).df())
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())
