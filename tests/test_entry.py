"""The entry points: every query runs, and agrees with its SQL where it has one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as S

SQL = S.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data, db, name):
    df = S.queries()[name](spark, data)
    r = db.execute(SQL[name])
    named = [c[0] for c in r.description]
    assert sorted(named) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in row) for row in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in row) for row in df.select(*named).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(S.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert S.queries()[name](spark, data).collect() is not None


def test_flagship(spark):
    assert S.entry(spark).count() > 0
