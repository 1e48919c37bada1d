"""Every query with SQL gives what DuckDB gives on the smallest tables; every other one runs."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from bazaarlake import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.date | datetime.datetime):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    got = QUERIES[name](spark, data)
    names = sorted(got.columns)
    have = Counter(str([plain(v) for v in r]) for r in got.select(*names).collect())
    answer = con.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    want = Counter(str([plain(r[columns.index(n)]) for n in names]) for r in answer.fetchall())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_names_have_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
