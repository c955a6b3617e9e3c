"""Catalyst clusters and factor-adjusted returns against cases worked by hand and least squares."""

import datetime as dt
import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, panel
from tidemark.plans import studies, tables

BASE = "Tesla announces expanded battery partnership with Rivian for commercial vehicles"
EDIT = "Tesla announces an expanded battery partnership with Rivian for new commercial vehicles"


def groups(spark, rows):
    at = dt.datetime(2026, 1, 2)
    df = spark.createDataFrame([(e, f"u{e}" if who is None else who, None if h is None else at + dt.timedelta(hours=h), title, tickers) for e, who, h, title, tickers in rows], "event_id string, identity string, public_time timestamp, title string, tickers array<string>")
    out = {}
    for r in clusters.catalysts(df).collect():
        out.setdefault(r.catalyst_id, set()).add(r.event_id)
    return sorted(map(sorted, out.values()))


def test_window_and_entities(spark):
    rows = [("a", None, 10, BASE, ["TSLA"]), ("b", None, 14, EDIT, ["RIVN", "TSLA"]), ("c", None, 30, EDIT, ["RIVN"]), ("d", None, 11, "Apple announces an expanded software partnership with Adobe for new services", ["AAPL"])]
    assert groups(spark, rows) == [["a", "b"], ["c"], ["d"]]


def test_same_words_need_a_shared_entity_and_generic_ones_do_not_count(spark):
    title = "Stocks update stocks rise as investors watch the daily policy meeting"
    assert groups(spark, [("a", None, 1, title, ["X"]), ("b", None, 2, title, ["Y"])]) == [["a"], ["b"]]
    assert groups(spark, [("a", None, 1, title, ["X"]), ("b", None, 2, title, ["x"])]) == [["a", "b"]]


def test_chain_ends_at_the_span(spark):
    assert groups(spark, [(e, None, h, BASE, ["TSLA"]) for e, h in (("a", 0), ("b", 8), ("c", 16))]) == [["a", "b"], ["c"]]


def test_identity_goes_first_and_rows_without_time_are_left_out(spark):
    rows = [("a", "one", 0, "first", None), ("b", "one", 5, "second wording", None), ("c", "one", 20, "third", None), ("n", "one", None, "x", None), ("p", " ", 3, None, None), ("q", "", 3, "", None)]
    assert groups(spark, rows) == [["a", "b"], ["c"], ["p"], ["q"]]


def test_repeats_and_empty_table(spark):
    assert groups(spark, [("a", "u", 0, BASE, ["T"]), ("a", "u", 0, BASE, ["T"]), ("b", "u", 0, BASE, ["R"])]) == [["a", "b"]]
    assert groups(spark, []) == []


def test_clusters_against_the_plain_order(spark):
    """All pairs, in order, on headlines that share words by chance."""
    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta eps zeta".split()
    rows = [(f"e{i:03}", None, int(rng.integers(0, 60)), " ".join(rng.choice(words, 5)), ["T"]) for i in range(80)]
    at = dt.datetime(2026, 1, 2)
    df = spark.createDataFrame([(e, f"u{e}", at + dt.timedelta(hours=h), title, t) for e, _, h, title, t in rows], "event_id string, identity string, public_time timestamp, title string, tickers array<string>")
    rev = {r.events[0]: r.rev for r in clusters.revisions(df).collect()}
    order = sorted(rows, key=lambda r: (r[2], rev[r[0]]))
    sets = [{i} for i in range(len(order))]
    for i, (_, _, h, title, _) in enumerate(order):
        for j in range(i):
            a, b = set(order[j][3].split()), set(title.split())
            both = len(a & b)
            like = both / len(a | b) >= 0.72 or (both / min(len(a), len(b)) >= 0.75 and difflib.SequenceMatcher(None, title, order[j][3]).ratio() >= 0.88)
            if h - order[j][2] <= 12 and like and sets[i] is not sets[j]:
                union = sets[i] | sets[j]
                hours = [order[k][2] for k in union]
                if max(hours) - min(hours) <= 12:
                    for k in union:
                        sets[k] = union
    want = sorted({tuple(sorted(order[k][0] for k in s)) for s in sets})
    assert [tuple(g) for g in groups(spark, rows)] == want and any(len(g) > 1 for g in want)


def test_first_link_is_the_assets_own(spark):
    at = dt.datetime(2026, 1, 2)
    m = spark.createDataFrame([("c", "e1", at, "TSLA"), ("c", "e3", at + dt.timedelta(hours=4), "RIVN"), ("c", "e2", at + dt.timedelta(hours=4), "TSLA"), ("c", "e4", at, None)], "catalyst_id string, event_id string, public_time timestamp, ticker string")
    assert {(r.ticker, r.first_link.hour, r.event_id) for r in clusters.first_links(m, "ticker").collect()} == {("TSLA", 0, "e1"), ("RIVN", 4, "e3")}


def test_factor_car_is_least_squares(spark):
    rng = np.random.default_rng(5)
    n, h, width, gap = 90, 5, 40, 3
    f, rf = rng.normal(0, 0.01, (n, 2)), np.full(n, 0.0001)
    opens, ret = 100 + rng.normal(0, 1, n), f @ [1.1, -0.4] + rng.normal(0, 0.005, n)
    close = opens * (1 + rng.normal(0, 0.01, n))
    rows = [("A", i, float(opens[i]), float(close[i]), None if i == 20 else float(ret[i]), float(rf[i]), float(f[i, 0]), None if i == 60 else float(f[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, idx int, open double, close double, ret double, rf double, x double, z double")
    got = {r.idx: r.car for r in panel.factor_car(df, ["x", "z"], h, width, gap, 30).collect()}
    ok = np.array([i not in (20, 60) for i in range(n)])
    for e in range(n):
        use = [i for i in range(max(0, e - gap - width), max(0, e - gap)) if ok[i]]
        if len(use) < 30 or e + h >= n:
            assert got[e] is None
            continue
        b = np.linalg.lstsq(np.column_stack([np.ones(len(use)), f[use]]), ret[use] - rf[use], rcond=None)[0][1:]
        day = lambda j, r: r if j == 60 else r - rf[j] - b @ f[j]
        want = day(e, close[e] / opens[e] - 1) + sum(day(j, ret[j]) for j in range(e + 1, e + h) if j != 20)
        assert got[e] == pytest.approx(want, abs=1e-9)


def test_factor_car_uses_nothing_after_the_gap(spark):
    df = spark.range(60).select(F.lit("A").alias("ticker"), F.col("id").cast("int").alias("idx"), F.lit(10.0).alias("open"), F.lit(10.0).alias("close"), (F.sin("id") / 100).alias("ret"), F.lit(0.0).alias("rf"), (F.cos("id") / 100).alias("x"))
    car = lambda d: {r.idx: r.car for r in panel.factor_car(d, ["x"], 2, 20, 5, 10).collect()}
    a, b = car(df), car(df.withColumn("ret", F.when(F.col("idx") >= 40, 9.0).otherwise(F.col("ret"))))
    assert a[30] is not None and all(a[i] == b[i] for i in range(39)) and a[39] != b[39]


def test_entities_are_those_of_the_pattern(spark):
    d = "/root/testdata/sf0.01"
    name = re.compile(clusters.NAME.removeprefix("(?U)"))
    want = set()
    for r in tables.headlines(spark, d).collect():
        want |= {(r.event_id, f"ticker:{r.publisher.upper()}")} if r.publisher else set()
        found = {" ".join(re.sub("[^a-z0-9]+", " ", x.lower()).split()) for x in name.findall(r.title or "")} - {"", *clusters.GENERIC}
        want |= {(r.event_id, f"name:{x}") for x in found}
    assert {tuple(r) for r in studies.entity_extract(spark, d).collect()} == want


def test_carhart_query_gives_returns_where_prices_allow(spark):
    d = "/root/testdata/sf0.01"
    got = [r.car for r in studies.carhart_car(spark, d).collect()]
    assert len(got) > 4000 and 0 < sum(x is not None for x in got) < len(got)


def test_unlike_headlines_of_one_publisher_are_no_candidates(spark):
    """A publisher's headlines of one day share an entity; compared are only those that share three quarters of the shorter one's words, and none of these is missed."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 16)))) for _ in range(150)]
    texts += [" ".join([w for w in t.split() if rng.random() > 0.15] + ["more"] * int(rng.integers(0, 2))) for t in texts]
    at = dt.datetime(2026, 1, 2)
    df = spark.createDataFrame([(f"e{i:03}", f"u{i}", at + dt.timedelta(minutes=i), t, ["T"]) for i, t in enumerate(texts)], "event_id string, identity string, public_time timestamp, title string, tickers array<string>")
    r = clusters.checkpointed(clusters.revisions(df).withColumn("id", F.monotonically_increasing_id()))
    event = {x.id: x.events[0] for x in r.collect()}
    got = {tuple(sorted((event[x.one], event[x.two]))) for x in clusters.candidates(r).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(f"e{i:03}", f"e{j:03}") for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * min(len(sets[i]), len(sets[j]))}
    assert want <= got and len(want) > 100 and len(got) < 2 * len(want)


def test_a_long_chain_is_one_component_in_few_rounds(spark, monkeypatch):
    """Labels that went one edge a round took about as many rounds as half the chain, and the planned size doubled its digits in each."""
    names = [str(x) for x in np.random.default_rng(2).permutation(np.arange(1000, 1400))]
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)) + [("a", "b")], "early string, late string")
    made, stored = [], clusters.stored
    monkeypatch.setattr(clusters, "stored", lambda df: made.append(1) or stored(df))
    got = {x.rev: x.component for x in clusters.connected(edges).collect()}
    assert got == {**dict.fromkeys(names, "1000"), "a": "a", "b": "a"} and len(made) < 40
