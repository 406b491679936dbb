"""Every query with SQL agrees with it on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n[1:2].isdigit() or n.startswith("p3")))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_plain(x) for x in r)) for r in df.select(*columns).collect())
    rows = duck.execute(entry.oracle_sql()[name])
    at = [x[0] for x in rows.description]
    assert sorted(at) == columns
    want = sorted(repr(tuple(_plain(r[at.index(c)]) for c in columns)) for r in rows.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
