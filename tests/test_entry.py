"""Every registered query against its SQL on the small tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def duck(small_dir):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{small_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else format(float(v), ".6g")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted((tuple(norm(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
