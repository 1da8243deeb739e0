"""Every registered query against its checking SQL on the given tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    problem, _, _ = check(spark, con, QUERIES[name], ORACLES.get(name), sf)
    assert problem is None, problem


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5
