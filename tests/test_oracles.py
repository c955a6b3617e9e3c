"""Every registered query with an oracle against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect(config={"memory_limit": "2GB"})
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return pd.Timestamp(v).isoformat()
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=lambda r: [(v is not None, f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert v == w or (isinstance(v, float) and v == pytest.approx(w, abs=2e-6, rel=1e-4))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run_and_repeat(spark, name):
    assert rows(QUERIES[name](spark, D).toPandas()) == rows(QUERIES[name](spark, D).toPandas())
