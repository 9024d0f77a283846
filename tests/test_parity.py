"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import collections
import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [m for m in entry._MODULES if ".llm" not in m.__name__]
SQL = {n: q for m in CORE for n, q in m.oracle_sql().items()}


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if v == v else "nan"
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = {n: q for m in CORE for n, q in m.queries().items()}[name](spark, data)
    columns = sorted(df.columns)
    got = collections.Counter(plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = collections.Counter(plain(tuple(row[names.index(c)] for c in columns)) for row in found.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted({n for m in CORE for n in m.queries()} - set(SQL)))
def test_others_run(spark, data, name):
    df = {n: q for m in CORE for n, q in m.queries().items()}[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() >= 0
