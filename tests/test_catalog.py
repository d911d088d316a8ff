"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


@pytest.fixture(scope="module")
def database():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal)):
            return str(v)
        return str(int(v)) if v == int(v) else f"{float(v):.6g}"  # whole numbers exactly

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, database, name):
    df = entry.queries()[name](spark, SMALL)
    found = database.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert cells(df.collect(), df.columns) == cells(found.fetchall(), found.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
