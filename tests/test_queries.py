"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest
from harness import compare, connect

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df_ok, message = compare(spark, QUERIES, SQL, name, SF, con)
    assert df_ok, message


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).columns
