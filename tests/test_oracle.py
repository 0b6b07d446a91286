"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}")
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return list(x) if isinstance(x, tuple | list) else x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.sql(entry.oracle_sql()[name])
    place = [res.columns.index(c) for c in cols]
    assert sorted(res.columns) == cols
    assert got == sorted((tuple(_plain(r[i]) for i in place) for r in res.fetchall()), key=repr)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
