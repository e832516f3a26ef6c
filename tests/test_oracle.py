"""Every named query against the independent SQL, over the whole tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, connection, name):
    assert differences(QUERIES[name](spark, folder), connection, ORACLES[name]) is None


def test_entry(spark):
    table = contract.entry(spark)
    assert table.count() == 6000
    assert {"risk_score", "verdict", "is_in_cycle", "is_hub_bank"} <= set(table.columns)
