"""Quantiles of whole columns against sorted values."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators import inference
from tidemark.plans import relational

POINTS = [0.0, 0.1, 0.33, 0.5, 0.67, 0.999, 1.0]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["spread", "few", "steep", "one", "edges"])
def test_quantiles_are_those_of_the_sorted_values(spark, kind):
    rng = np.random.default_rng(1)
    x = {
        "spread": rng.normal(0, 1, 5000), "few": rng.integers(0, 3, 1000) * 1.5, "steep": np.exp(rng.uniform(-600, 600, 2000)),
        "one": np.array([4.25]), "edges": np.array([-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324, 1e-300]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    s, want = np.sort(x), []
    for p in POINTS:
        place = (len(s) - 1) * p
        lo, hi = math.floor(place), math.ceil(place)
        want.append(s[lo] if s[lo] == s[hi] else (hi - place) * s[lo] + (place - lo) * s[hi])
    assert market.quantiles(df, "x", POINTS) == want


def test_quantiles_of_infinite_values_nan_and_nothing(spark):
    df = spark.createDataFrame([(v,) for v in (math.nan, math.inf, -math.inf, 1.0, math.nan, 2.0, None)], "x double")
    assert market.quantiles(df, "x", [0.0, 0.2, 0.4, 0.6])[:4] == [-math.inf, 1.0, 2.0, math.inf]
    assert math.isnan(market.quantiles(df, "x", [1.0])[0])
    assert market.quantiles(df.where("x is null"), "x", [0.5]) == [None]


def test_tercile_split_holds_no_map_of_distinct_values(spark):
    x = relational.tercile_split(spark, "/root/testdata/sf0.001")
    assert "percentile" not in plan(x) and sum(r.n for r in x.collect()) == 1500


def test_decile_table_holds_no_map_of_distinct_values(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "x double")
    x = market.quantile_table(df, "x", 10)
    assert "percentile" not in plan(x)
    assert {(r.bin, r.n, r["mean"]) for r in x.collect()} == {(0, 3, 0.5), *((b, 1, b + 1.0) for b in range(1, 9)), (9, 1, 10.0)}
    assert market.quantile_table(df.where("x is null"), "x", 10).collect() == [(0, 1, None)]


def test_two_way_bootstrap_joins_no_table_of_weights_and_leaves_out_missing_clusters(spark):
    rows = [("a", 1, 1.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 2, None), ("c", 1, 9.0), (None, 1, 100.0), ("a", None, 100.0)]
    df = spark.createDataFrame(rows, "one string, two int, x double")
    got = inference.two_way_bootstrap(df, "one", "two", "x", draws=60, least=1)
    weight = lambda s, d, k: sum(int(hashlib.md5(f"{s}|{d}|{k}".encode()).hexdigest()[:8], 16) / 2**32 >= p for p in inference.POISSON)
    means = []
    for d in range(1, 61):
        w = [(weight(23, d, a) * weight(24, d, b), x) for a, b, x in rows if a and b and x is not None]
        if total := sum(v for v, _ in w):
            means.append(sum(v * x for v, x in w) / total)
    r = got.first()
    assert r.n == 6 and (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)
    assert not re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", plan(got))
