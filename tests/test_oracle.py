"""Every query with SQL against DuckDB on sf0.001."""

import os

import duckdb
import pandas as pd
import pytest

from lumenlog.plans import evaluations, more, queries as plans, scale

assert more and evaluations and scale  # add their queries to plans
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "conversations", "orders", "customer", "lineitem", "part", "supplier"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) else v for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_duckdb(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(plans.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).columns
