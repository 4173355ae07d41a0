"""Every query with SQL gives DuckDB's rows on the same tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return 0.0 if float(x) == 0 else float(f"{float(x):.9g}")
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, tiny, name):
    df = entry.queries()[name](spark, tiny)
    want = duck.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got == expected
    assert got, "a query without rows checks nothing"
