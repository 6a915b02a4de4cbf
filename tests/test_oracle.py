"""Every registered query against its SQL, on the smallest driver tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from loopstats.plans.registry import QUERIES

ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_and_back():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, sf_dir, name):
    assert difference(spark, con, contract.queries()[name], ORACLES[name], sf_dir) is None
