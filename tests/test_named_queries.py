"""Every named query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, FOLDER, QUERIES[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_every_statement_belongs_to_a_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 25
