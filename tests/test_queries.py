"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR, TABLES

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(frame):
    rows = []
    for row in frame[sorted(frame.columns)].itertuples(index=False, name=None):
        rows.append(
            tuple(
                None if pd.isna(v) else (float(v) if isinstance(v, Number) and not isinstance(v, bool) else str(v))
                for v in row
            )
        )
    return sorted(rows, key=lambda r: [("" if v is None else f"{v:.4f}" if isinstance(v, float) else v) for v in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 120


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = canonical(got), canonical(want)
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert all(same(a, b) for a, b in zip(x, y, strict=True)), (x, y)
