"""Every registered query with a SQL twin matches DuckDB on the same parquet tables."""

import os

import pytest

from knockon.plans import catalog
from tests.oracle_compare import compare, duck

ORACLE_SF = os.environ.get("KNOCKON_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(ORACLE_SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_duckdb(spark, con, name):
    ok, msg = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], ORACLE_SF)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["prev_delay_bin", "bin_order", "delay_rate", "n_obs"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
