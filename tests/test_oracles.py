"""Every registered query with SQL against DuckDB: all on the smallest tables, and on the next larger ones those that read
stories, some of which have no vector and no label only there."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from engram.plans import catalogue
from engram.plans.views import TABLES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(LARGER).is_dir(), reason="no test tables")


def connected(data):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def ducks():
    return {data: connected(data) for data in (SMALL, LARGER)}


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


CASES = [(SMALL, n) for n in sorted(catalogue.oracle_sql())] + [(LARGER, n) for n, sql in sorted(catalogue.oracle_sql().items()) if "stories AS (" in sql]


@pytest.mark.parametrize(("data", "name"), CASES, ids=[f"{n}-{d[15:]}" for d, n in CASES])
def test_query(spark, ducks, data, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = ducks[data].sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in want.fetchall()), key=repr)
