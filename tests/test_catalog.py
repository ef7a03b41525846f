"""Every query against DuckDB on the smallest tables."""

import datetime as dt
import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from augury.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19].removesuffix(" 00:00:00") if isinstance(v, (dt.date, dt.datetime)) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = rows(df.columns, df.collect())
    if name in catalog.SQL:
        said = duck.execute(catalog.SQL[name])
        names = [c[0] for c in said.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, said.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
