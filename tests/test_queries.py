"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from bidframe import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_oracle(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    cur = duck.execute(plans.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
