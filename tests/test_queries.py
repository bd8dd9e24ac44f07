"""Every registered query against its SQL, on the whole small tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_result(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert problem is None, problem


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 1500
