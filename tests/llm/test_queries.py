"""The queries of this subpackage that SQL can say, on the smallest data."""

import os

import duckdb
import pytest

from tesserae.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    cursor = con.execute(Q.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = Q.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    Q.QUERIES[name](spark, DATA).collect()
