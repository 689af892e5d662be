"""Every analytics query against DuckDB on the same tables; those without SQL give rows."""

from __future__ import annotations

import datetime
import os

import duckdb
import pandas as pd
import pytest

from marlstone.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def comparable(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, datetime.date | datetime.datetime | pd.Timestamp):
            return pd.Timestamp(v).isoformat()
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert comparable(got) == comparable(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
