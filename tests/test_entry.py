"""Driver contract: entry(), queries(), oracle_sql(); a sample of queries
checked against DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF

TABLES = ["orders", "lineitem", "events"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "version_id" in df.columns


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50
    assert not {x for x in set(q) - set(o) if not x.startswith("op") and x != "pipeline"}


@pytest.mark.parametrize("name", ["classify_versions", "eligible_either", "decide", "run_outcome", "schema_drift"])
def test_sample_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert got.count() == len(want)
