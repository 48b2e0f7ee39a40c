import os

import duckdb
import pytest

import __spark_entry__ as entry
from vellumine.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows(df):
    cell = lambda x: "NULL" if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        expected = duck.execute(registry.ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
