"""Hand-computed cases and leakage checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators import inference, panel, portfolio, sequence
from tidemark.operators.asof import asof
from tidemark.operators.tables import upsert
from tidemark.plans import studies, tables
from tidemark.sources import files
from tidemark.streaming import bars as stream


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_regular_session_slots(spark):
    df = spark.createDataFrame([(ts(f"2026-07-06 {x}"),) for x in ("13:29", "13:30", "19:59", "20:00")], "ts timestamp")
    assert [r.slot for r in market.regular_session(df, "ts").orderBy("slot").collect()] == [0, 389]


def test_past_z_ignores_the_future(spark):
    data = [("A", i, float(i * i % 7)) for i in range(12)]
    changed = [(k, i, v + (100 if i >= 8 else 0)) for k, i, v in data]
    z = lambda rows: {r.i: r.z for r in spark.createDataFrame(rows, "k string, i int, x double").select("i", panel.past_z("x", "k", "i", 4).alias("z")).collect()}
    a, b = z(data), z(changed)
    assert a[3] is None and a[4] is not None
    assert all(a[i] == b[i] for i in range(8)) and a[8] != b[8]


def test_two_factor_residual_recovers_betas(spark):
    rows = [("A", i, (i * 37 % 11) / 10.0, (i * 53 % 13) / 10.0) for i in range(30)]
    df = spark.createDataFrame([(k, i, m, s, 1.2 * m + 0.7 * s + 0.1) for k, i, m, s in rows], "k string, i int, m double, s double, y double")
    ba, bb, resid = panel.two_factor_residual("y", "m", "s", "k", "i", 10)
    out = df.select("i", ba.alias("a"), bb.alias("b"), resid.alias("r")).where("i >= 10").collect()
    assert all(abs(r.a - 1.2) < 1e-9 and abs(r.b - 0.7) < 1e-9 and abs(r.r - 0.1) < 1e-9 for r in out)  # the intercept stays in the residual


def test_asof_sides_and_tolerance(spark):
    left = spark.createDataFrame([("A", 1, ts("2024-01-01 14:31")), ("B", 2, ts("2024-01-01 14:31"))], "k string, id int, t timestamp")
    right = spark.createDataFrame([("A", ts(f"2024-01-01 14:{m}"), float(v)) for m, v in ((30, 100), (31, 200), (32, 300))], "k string, t timestamp, px double")
    get = lambda **kw: {r.id: r.px for r in asof(left, right, ["k"], "t", "t", ["px"], **kw).collect()}
    assert get() == {1: 200.0, 2: None}
    assert get(strict=True)[1] == 100.0
    assert get(forward=True)[1] == 200.0 and get(forward=True, strict=True)[1] == 300.0
    assert get(strict=True, tolerance=30)[1] is None


def test_cooldown_counts_from_the_last_kept(spark):
    rows = [("A", ts(f"2024-01-01 10:{m:02}")) for m in (0, 30, 59)] + [("A", ts("2024-01-01 11:00")), ("B", ts("2024-01-01 10:00"))]
    kept = sequence.cooldown(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts", 3600).orderBy("k", "ts").collect()
    assert [(r.k, r.ts.hour) for r in kept] == [("A", 10), ("A", 11), ("B", 10)]


def test_cusum_signs_and_nulls(spark):
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate([0.5, None, 0.5, -2.0])], "k string, i int, x double")
    out = [r["cusum"] for r in sequence.cusum_by(df, ["k"], "i", "x", 0.1).orderBy("i").collect()]
    assert out == pytest.approx([0.4, None, 0.8, 1.9])


def test_barrier_tie_rules(spark):
    bars = spark.createDataFrame([("A", 1, 10.0, 10.0, 10.0, 10.0), ("A", 2, 10.0, 20.0, 1.0, 10.0)], "k string, idx int, open double, high double, low double, close double")
    e = spark.createDataFrame([("A", 1, 1)], "k string, idx int, side int")
    reason = lambda first: sequence.barrier(e, bars, "k", 3, 0.5, 0.5, first).first().reason
    assert (reason(False), reason(True)) == ("take", "stop")


def test_cap_weights_water_filling_and_cash(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in (("a", 60.0), ("b", 20.0), ("c", 10.0), ("d", 10.0))], "g int, k string, w double")
    out = {r.k: r.capped for r in portfolio.cap_weights(df, ["g"], "w", 0.4).collect()}
    assert out == pytest.approx({"a": 0.4, "b": 0.3, "c": 0.15, "d": 0.15})
    two = {r.k: r.capped for r in portfolio.cap_weights(df.where("k in ('a', 'b')"), ["g"], "w", 0.4).collect()}
    assert two == pytest.approx({"a": 0.4, "b": 0.4})  # the rest is cash


def test_concurrency_cap(spark):
    rows = [(i, ts(f"2024-01-0{a}"), ts(f"2024-01-0{b}")) for i, a, b in ((1, 1, 5), (2, 2, 6), (3, 3, 7), (4, 5, 9))]
    both = spark.createDataFrame([(b, *r) for b in "xy" for r in rows], "book string, id long, s timestamp, e timestamp")
    kept = sequence.concurrency_cap(both, ["book"], "s", "e", 2).where("book = 'y'")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4]


def test_concurrency_cap_takes_all_trades(spark):
    d = "/root/testdata/sf0.001"
    trades = sorted((r.tx_date, r.tx_date + dt.timedelta(20), r.trade_id) for r in tables.disclosures(spark, d).collect())
    still, want = [], set()
    for start, stop, i in trades:
        still = [x for x in still if x > start]
        if len(still) < 5:
            still.append(stop)
            want.add(i)
    assert {r.id for r in studies.concurrency_cap(spark, d).collect()} == want


def test_guidance_chain(spark):
    rows = [("A", 1, ts("2024-01-01"), 100.0, "STATED"), ("A", 2, ts("2024-01-08"), 110.0, "RAISED"), ("A", 3, ts("2024-01-08"), 120.0, "RAISED"), ("A", 4, ts("2024-01-15"), 0.0, "REAFFIRMED"), ("A", 5, ts("2024-01-16"), 0.0, "WITHDRAWN")]
    out = {r.id: r.revision for r in sequence.carry_links(spark.createDataFrame(rows, "k string, id int, t timestamp, v double, a string"), ["k"], "t", "v", "a").collect()}
    assert out[1] is None and out[2] == pytest.approx(0.1) and out[3] == pytest.approx(0.2)  # equal times do not link
    assert out[4] == 0.0 and out[5] is None


def test_permutation_keeps_strata(spark):
    df = spark.createDataFrame([(i, i % 3, i * 10) for i in range(30)], "id int, g int, x int")
    out = inference.permuted(df, ["g"], "x", "id").collect()
    assert len(out) == 30
    assert {(r.g, r.permuted) for r in out} == {(r.g, r.x) for r in out} and any(r.x != r.permuted for r in out)


def test_bootstrap_is_centred_and_repeats(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("c"), (F.col("id") % 10).cast("double").alias("x"))
    a, b = (inference.cluster_bootstrap(df, "c", "x").first() for _ in range(2))
    assert a == b and a["low"] < a["mean"] < a["high"]


def test_normal_quantities():
    assert inference.power_n(0.01, 0.04) == pytest.approx(125.6, abs=0.3)
    assert inference.expected_max_sharpe(1.0, 100) == pytest.approx(2.53, abs=0.02)


def test_quote_and_aggressor(spark):
    r = spark.range(1).select(market.spread_bps(F.lit(100.0), F.lit(100.10)).alias("s"), market.aggressor(F.lit(100.2), F.lit(100.0), F.lit(100.1), F.lit(None)).alias("a"), market.aggressor(F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(99.0)).alias("locked")).first()
    assert r.s > 9 and r.a == "BUY" and r.locked is None


def test_fill_simulation(spark):
    f = lambda qty, **kw: spark.range(1).select(market.fill(F.lit("BUY"), F.lit(qty), F.lit(10.02), F.lit(10.0), F.lit(500), F.lit(10.02), F.lit(500), **kw).alias("f")).first().f
    assert (f(300).status, f(300).filled, f(300).price) == ("FILLED", 300, pytest.approx(10.02))
    assert (f(800).status, f(800).filled) == ("PARTIAL", 500)
    assert f(300, adverse_bps=20.0).status == "REJECTED"
    assert f(800, depth_bps=10.0, depth_size=F.lit(1000)).status == "FILLED"


def test_numbers_and_text(spark):
    r = spark.range(1).select(text.number_scaled(F.lit("about $1.5 million")).alias("a"), text.number_scaled(F.lit("in 2024")).alias("b"), text.plain_text(F.lit("<p>a<script>x<1</script> b</p>")).alias("c")).first()
    assert (r.a, r.b, r.c) == (1.5e6, None, "a b")


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_sources(spark, tmp_path):
    (tmp_path / "f.txt").write_text("header\n20240102, 1.0, 2.0\nnote\n")
    assert [tuple(r) for r in files.read_fixed_block(spark, str(tmp_path / "f.txt"), ["a", "b"]).collect()] == [(dt.date(2024, 1, 2), 0.01, 0.02)]
    (tmp_path / "g.jsonl").write_text('# note\n{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "g.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "m.json").write_text('{"records": [{"a": 1}, {"a": 5}]}')
    assert sorted(r.a for r in files.read_manifest(spark, str(tmp_path / "m.json"), "a: int").collect()) == [1, 5]
    with pytest.raises(files.SourceError):
        files.pinned(spark, str(tmp_path / "f.txt"), "0" * 64)
    with pytest.raises(files.SourceError):
        files.read_by_suffix(spark, "x.xlsx")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        files.append_new(spark, str(tmp_path / "t"), df, ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_bars_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartitionByRange(3, "ts")
    e.write.parquet(str(tmp_path / "in"))
    q = stream.quotes_of(stream.event_stream(spark, str(tmp_path / "in")))
    stream.drain(stream.stream_bars(q, "30 minutes", "60 days"), str(tmp_path / "c1"), "bars_out", "complete")
    batch = portfolio.flow_bars(stream.quotes_of(e.withColumn("ts", F.col("ts").cast("timestamp"))), "30 minutes")
    key = lambda df: sorted((r.ticker, r.start, r.trades, round(r.buy, 6)) for r in df.collect())
    assert key(spark.table("bars_out")) == key(batch)


def test_stream_cusum_and_dedupe_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([("A", ts(f"2024-01-01 10:{i:02}"), [0.5, -0.2, 0.4, -1.0][i % 4]) for i in range(12)], "ticker string, ts timestamp, x double").withColumn("day", F.to_date("ts"))
    rows.repartitionByRange(2, "ts").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.drain(stream.stream_cusum(s, 0.1), str(tmp_path / "c1"), "cusum_out")
    want = sequence.cusum_by(rows, ["ticker", "day"], "ts", "x", 0.1).orderBy("ts").collect()
    assert [r["cusum"] for r in spark.table("cusum_out").orderBy("ts").collect()] == pytest.approx([r["cusum"] for r in want])
    d = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.drain(stream.stream_dedupe(d, ["ticker"]), str(tmp_path / "c2"), "dedupe_out")
    assert spark.table("dedupe_out").count() == 1
