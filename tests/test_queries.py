"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from fernweave import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("set timezone = 'UTC'")
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return out


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return f"{round(float(v), 9):.9f}"
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert rows(plans.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).columns
