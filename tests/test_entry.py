"""Every query with SQL gives the rows DuckDB gives, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
CORE = [m for m in entry._catalogue() if ".llm." not in m.__name__]
NAMES = sorted(n for m in CORE for n in m.SQL)
ROWS_ONLY = sorted(n for m in CORE for n in m.QUERIES if n not in m.SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda x: repr(round(x, 6) + 0.0 if isinstance(x, float) and x == x else None if isinstance(x, float) else x)
    return sorted(tuple(say(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
