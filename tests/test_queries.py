"""Every registered query of the engine against its SQL, on the smoke tables."""

import glob
import math
import os

import duckdb
import pytest

from reprolith.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda r: repr([plain(r[c]) if not isinstance(r[c], int) or isinstance(r[c], bool) else float(r[c]) for c in sorted(r)])
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
