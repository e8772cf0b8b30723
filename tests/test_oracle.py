"""Every named query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tarnlink import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert got == want and got
