"""Every catalogue query against its DuckDB oracle on the small test tables."""

import pytest
from oracle import compare, duck

from pairwright.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, con, name):
    ok, msg = compare(QUERIES[name](spark, sf), ORACLES[name], con)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
