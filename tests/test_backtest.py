"""Rule backtests against a plain loop over days, and cases worked by hand."""

import random

import pytest

from tidemark.operators import backtest

C, O = "book string, ticker string, ready int, priority double", "ticker string, idx int, open double"


def day_by_day(cands, px, end, places, hold, fresh, bps):
    """Positions and equity of one book, one day after the other."""
    last = {t: max(i for u, i in px if u == t) for t, _ in px}
    held, weights, marks, equity, taken, curve = {}, {}, {}, 1.0, [], {}
    for day in range(end + 1):
        gain = 0.0
        for t, w in weights.items():
            now = px.get((t, day), marks[t])
            gain += w * (now / marks[t] - 1)
            marks[t] = now
        equity *= 1 + gain
        held = {t: e for t, e in held.items() if not (day >= e or day > last[t])}
        wish = {}
        for t, ready, priority in cands:
            if ready <= day <= ready + fresh and (t, day) in px and t not in held:
                wish[t] = max(wish.get(t, priority), priority)
        for t in sorted(wish, key=lambda t: (-wish[t], t))[: places - len(held)]:
            held[t], marks[t] = day + hold, px[t, day]
            taken.append((t, day))
        after = {t: 1 / places for t in held}
        turn = sum(abs(after.get(t, 0) - weights.get(t, 0)) for t in {*after, *weights}) / 2
        equity *= 1 - turn * 2 * bps / 1e4
        weights, curve[day] = after, equity
    return sorted(taken), curve


def test_books_equal_the_plain_loop(spark):
    rng = random.Random(4)
    px = {(t, i): 10 + rng.random() for t in "ABCDEF" for i in range(60 if t != "C" else 25) if rng.random() < 0.8}
    px |= {(t, 59): 10.5 for t in "ABDEF"}
    cands = {b: [(rng.choice("ABCDEFZ"), rng.randrange(0, 55), float(rng.randrange(6))) for _ in range(40)] for b in "xy"}
    opens = spark.createDataFrame([(t, i, v) for (t, i), v in px.items()], O)
    rows = spark.createDataFrame([(b, *c) for b, cs in cands.items() for c in cs], C)
    got = backtest.admit(rows, opens, ["book"], 2, hold=7, fresh=3)
    curve = backtest.nav(got, opens, opens.select("idx").distinct(), ["book"], 2, 10.0).collect()
    for b, cs in cands.items():
        want, line = day_by_day([c for c in cs if c[0] != "Z"], px, 59, 2, 7, 3, 10.0)
        assert sorted((r.ticker, r.entry) for r in got.where(f"book = '{b}'").collect()) == want and len(want) > 8
        mine = {r.idx: r.equity for r in curve if r.book == b}
        assert set(mine) == set(range(want and min(d for _, d in want), 60))
        assert all(mine[i] == pytest.approx(line[i], rel=1e-9) for i in mine)


def test_places_priority_freshness_and_delisting(spark):
    opens = spark.createDataFrame([(t, i, 10.0) for t in "ABC" for i in range(20) if (t, i) < ("C", 6)] + [("D", 15, 0.0)], O)
    rows = [("b", "A", 0, 1.0), ("b", "B", 0, 2.0), ("b", "C", 1, 9.0), ("b", "D", 15, 9.0), ("b", None, 0, 9.0), ("b", "A", None, 9.0), ("b", "A", 0, None)]
    got = backtest.admit(spark.createDataFrame(rows, C), opens, ["book"], 1, hold=4, fresh=5)
    # B first by priority, C when its place is free, and C leaves after its last price
    assert [(r.ticker, r.entry, r.exit) for r in got.orderBy("entry").collect()] == [("B", 0, 4), ("C", 4, 6)]


def test_repeats_and_empty(spark):
    opens = spark.createDataFrame([("A", i, 10.0) for i in range(9)], O)
    twice = backtest.admit(spark.createDataFrame([("b", "A", 0, 1.0)] * 2, C), opens, ["book"], 2, hold=3, fresh=1)
    assert [(r.entry, r.exit) for r in twice.collect()] == [(0, 3)]
    none = backtest.admit(spark.createDataFrame([], C), opens, ["book"], 2)
    assert none.count() == 0 and backtest.nav(none, opens, opens.select("idx"), ["book"], 2, 1.0).count() == 0
