"""Every registered query runs; where it has SQL, DuckDB gives the same rows."""

import pytest

import __spark_entry__ as entry
from lithograph.plans.registry import ORACLES, QUERIES
from tests.oracle import connection, rows


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
