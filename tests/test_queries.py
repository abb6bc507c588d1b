"""Every registered query against its SQL, and the contract of the registry."""

import re

import pytest

import __spark_entry__ as registry
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, engine, name):
    outcome, _ = compare(spark, engine, name, QUERIES[name], SQL[name], FOLDER)
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert all(re.match(r"ml_|op\d+_|pipeline$", name) for name in set(QUERIES) - set(SQL))


def test_entry(spark):
    assert registry.entry(spark).count() == 1
