"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from trajframe.plans.all import QUERIES, SQL

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    """Rows with columns in order of name; floats by value."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, str(SF))
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0
