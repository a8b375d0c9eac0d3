"""Every registered query runs; those with SQL agree with DuckDB value by value."""

import importlib
import os

import pytest
from oracle import compare, connect

from labelpool.queries import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTERED = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, con, name):
    query, sql = REGISTERED[name]
    problem, _, _ = compare(spark, con, SF, query, sql)
    assert problem is None, problem


def test_entry_module(spark):
    module = importlib.import_module("__spark_entry__")
    assert set(module.oracle_sql()) <= set(module.queries()) >= set(REGISTERED)
    assert module.entry(spark).count() == 10
