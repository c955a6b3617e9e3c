"""Queries over outcomes of events and decisions: hurdles, controls, stability, metrics of predictions."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.asof import asof
from tidemark.operators.panel import trailing
from tidemark.operators.tables import best
from tidemark.plans import tables as t
from tidemark.registry import query
from tidemark.session import load


def R6(c):
    return F.round(c, 6)


@query("trade_decision", """WITH s AS (SELECT o_orderkey AS trade_id, o_totalprice AS px, (o_orderkey % 401 - 200) / 10000.0::DOUBLE AS score, CASE WHEN o_orderkey % 30 < 29 THEN (o_orderkey % 30 - 5) / 10.0::DOUBLE END AS beta FROM orders),
  c AS (SELECT *, 2 * 15 / 10000.0::DOUBLE * (1 + abs(beta)) AS cost FROM s), g AS (SELECT *, CASE WHEN abs(score) * 10000 > 2 * cost * 10000 + 1e-9 THEN CAST(sign(score) AS INT) ELSE 0 END AS side FROM c)
  SELECT trade_id, CASE side WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'NO TRADE' END AS action, round(2 * cost * 10000, 4) AS hurdle_bps, round(px * (1 + side * 0.0015::DOUBLE) + 1e-7, 4) AS entry_fill, round(px * (1 - side * 0.0015::DOUBLE) + 1e-7, 4) AS exit_fill, round(score - cost, 8) AS after_cost FROM g""")
def trade_decision(spark, d):
    """A trade only where the score is beyond twice the cost of both legs; a fill pays the cost against its side."""
    k = F.col("o_orderkey")
    x = load(spark, d, "orders").select(k.alias("trade_id"), F.col("o_totalprice").alias("px"), ((k % 401 - 200) / 10000.0).alias("score"), F.when(k % 30 < 29, (k % 30 - 5) / 10.0).alias("beta"))
    x = x.withColumn("cost", 2 * 15 / 10000.0 * (1 + F.abs("beta")))
    x = x.withColumn("side", F.when(F.abs("score") * 10000 > 2 * F.col("cost") * 10000 + 1e-9, F.sign("score")).otherwise(0.0))
    action = F.when(F.col("side") > 0, "BUY").when(F.col("side") < 0, "SELL").otherwise("NO TRADE")
    fill = lambda way: F.round(F.col("px") * (1 + way * F.col("side") * 0.0015) + 1e-7, 4)
    return x.select("trade_id", action.alias("action"), F.round(2 * F.col("cost") * 10000, 4).alias("hurdle_bps"), fill(1).alias("entry_fill"), fill(-1).alias("exit_fill"), F.round(F.col("score") - F.col("cost"), 8).alias("after_cost"))


@query("hedged_leg", """quotes: WITH n AS (SELECT *, lead(bid) OVER o AS xb, lead(ask) OVER o AS xa, lead(value) OVER o AS xv, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS side, (user_id % 20 - 4) / 10.0::DOUBLE AS beta, 100.0::DOUBLE AS b0, 100 + user_id % 3 - 1 AS b1 FROM quotes WINDOW o AS (PARTITION BY ticker ORDER BY ts, event_id)),
  p AS (SELECT *, bid > 0 AND xb > 0 AND k > 0 AS nbbo FROM n), e AS (SELECT *, CASE WHEN NOT nbbo THEN value WHEN side > 0 THEN ask ELSE bid END AS entry, CASE WHEN NOT nbbo THEN xv WHEN side > 0 THEN xb ELSE xa END AS exit FROM p WHERE xv IS NOT NULL)
  SELECT event_id, CASE WHEN nbbo THEN 'NBBO' ELSE 'BAR' END AS mode, round(CASE WHEN entry > 0 AND exit > 0 THEN side * (exit / entry - 1) + abs(beta) * (CASE WHEN beta >= 0 THEN -side ELSE side END) * (b1 / b0 - 1) - 0.003::DOUBLE * (1 + abs(beta)) END, 6) AS net FROM e""")
def hedged_leg(spark, d):
    """Buys at the ask and sells at the bid where both quotes are there, else at the bars; the hedge is beta times the benchmark, both legs pay."""
    o = W.partitionBy("ticker").orderBy("ts", "event_id")
    x = t.quotes(spark, d).withColumns({"xb": F.lead("bid").over(o), "xa": F.lead("ask").over(o), "xv": F.lead("value").over(o)}).where("xv is not null")
    x = x.withColumns({"side": F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1), "beta": (F.col("user_id") % 20 - 4) / 10.0, "bench": (F.col("user_id") % 3 - 1) / 100.0})
    nbbo, buy = (F.col("bid") > 0) & (F.col("xb") > 0) & (F.col("k") > 0), F.col("side") > 0
    entry = F.when(~nbbo, F.col("value")).when(buy, F.col("ask")).otherwise(F.col("bid"))
    leave = F.when(~nbbo, F.col("xv")).when(buy, F.col("xb")).otherwise(F.col("xa"))
    hedge = F.when(F.col("beta") >= 0, -F.col("side")).otherwise(F.col("side"))
    net = F.col("side") * (leave / entry - 1) + F.abs("beta") * hedge * F.col("bench") - 0.003 * (1 + F.abs("beta"))
    return x.select("event_id", F.when(nbbo, "NBBO").otherwise("BAR").alias("mode"), R6(F.when((entry > 0) & (leave > 0), net)).alias("net"))


@query("composite_surprise", """SELECT o_orderkey AS trade_id, round(list_avg([x for x in [a, b, c] if x IS NOT NULL]) + 1e-9, 6) AS surprise, round(list_avg([x for x in [a, b, c] if x IS NOT NULL]) - r + 1e-9, 6) AS mismatch FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 100000 END AS a,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7)::DOUBLE END AS b, CASE WHEN o_orderkey % 5 = 0 THEN -1.5::DOUBLE END AS c, (o_orderkey % 11) / 10.0::DOUBLE AS r FROM orders)""")
def composite_surprise(spark, d):
    """The mean of the measures that are there, and what it is beyond the reaction."""
    k = F.col("o_orderkey")
    parts = [F.when(k % 2 == 0, F.col("o_totalprice") / 100000), F.when(k % 3 == 0, (k % 7).cast("double")), F.when(k % 5 == 0, F.lit(-1.5))]
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), n)
    return load(spark, d, "orders").select(k.alias("trade_id"), R6(mean + 1e-9).alias("surprise"), R6(mean - (k % 11) / 10.0 + 1e-9).alias("mismatch"))


@query("stability_gates", """disc, members: WITH x AS (SELECT year(filing_date) AS y, sector, ticker, amount - 150000 AS pnl FROM disc JOIN members USING (member)), p AS (SELECT sum(pnl) AS s FROM x WHERE pnl > 0),
  g AS (SELECT 'year' AS dim, CAST(y AS VARCHAR) AS v, count(*) AS n, sum(pnl) AS s, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS w FROM x GROUP BY 2 UNION ALL SELECT 'sector', sector, count(*), sum(pnl), sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) FROM x GROUP BY 2 UNION ALL SELECT 'ticker', ticker, count(*), sum(pnl), sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) FROM x GROUP BY 2)
  SELECT dim, count(*) FILTER (WHERE n >= 30) AS eligible, round(avg(CASE WHEN n >= 30 THEN CASE WHEN g.s > 0 THEN 1.0 ELSE 0.0 END END), 6) AS positive_share, round(max(w) / any_value(p.s), 6) AS max_share, max(w) / any_value(p.s) <= 0.25 AS concentration_ok FROM g, p GROUP BY 1""")
def stability_gates(spark, d):
    """Per dimension: groups of 30 trades and more, the share of them that gain, and the largest share of all gains."""
    x = t.disclosures(spark, d).join(t.members(spark, d), "member").withColumn("pnl", F.col("amount") - 150000)
    dims = F.create_map(F.lit("year"), F.year("filing_date").cast("string"), F.lit("sector"), F.col("sector"), F.lit("ticker"), F.col("ticker"))
    won = F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)
    g = x.select(F.explode(dims).alias("dim", "v"), "pnl", won.alias("won")).groupBy("dim", "v").agg(F.count("*").alias("n"), F.sum("pnl").alias("s"), F.sum("won").alias("w"))
    share = F.max("w") / F.sum("w")
    ok = F.col("n") >= 30
    return g.groupBy("dim").agg(F.count_if(ok).alias("eligible"), R6(F.avg(F.when(ok, F.when(F.col("s") > 0, 1.0).otherwise(0.0)))).alias("positive_share"), R6(share).alias("max_share"), (share <= 0.25).alias("concentration_ok"))


@query("minute_profile", "SELECT event_type AS ticker, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute, count(*) AS n, round(avg(value), 6) AS volume FROM events GROUP BY 1, 2")
def minute_profile(spark, d):
    """Mean volume per ticker and minute of the day."""
    minute = (F.hour("ts") * 60 + F.minute("ts")).alias("minute")
    return load(spark, d, "events").groupBy(F.col("event_type").alias("ticker"), minute).agg(F.count("*").alias("n"), R6(F.avg("value")).alias("volume"))


LEVELS = (("member", ["member", "tx_type"]), ("sector", ["sector", "tx_type"]), ("metric", ["tx_type"]))


@query("hierarchical_z", """disc, members: WITH x AS (SELECT trade_id, member, sector, tx_type, filing_date, amount FROM disc JOIN members USING (member)), w AS (SELECT *, count(*) OVER a AS n1, avg(amount) OVER a AS m1, stddev_samp(amount) OVER a AS s1, count(*) OVER b AS n2, avg(amount) OVER b AS m2, stddev_samp(amount) OVER b AS s2, count(*) OVER c AS n3, avg(amount) OVER c AS m3, stddev_samp(amount) OVER c AS s3 FROM x
  WINDOW a AS (PARTITION BY member, tx_type ORDER BY filing_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY sector, tx_type ORDER BY filing_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), c AS (PARTITION BY tx_type ORDER BY filing_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
  SELECT trade_id, CASE WHEN n1 >= 5 THEN 'member' WHEN n2 >= 5 THEN 'sector' WHEN n3 >= 5 THEN 'metric' END AS level, round(CASE WHEN n1 >= 5 THEN (amount - m1) / s1 WHEN n2 >= 5 THEN (amount - m2) / s2 WHEN n3 >= 5 THEN (amount - m3) / s3 END, 4) AS z FROM w""")
def hierarchical_z(spark, d):
    """z-score on what was filed on earlier days, at the finest level with five values: member, sector, all.

    Values are summed up by level and day before any window, so a level that holds a third of all rows is as many rows as it has days.
    """
    x = t.disclosures(spark, d).join(t.members(spark, d).select("member", "sector"), "member")
    level, z = F, F
    for name, keys in LEVELS:
        day = x.groupBy(*keys, "filing_date").agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.sum(F.col("amount") * F.col("amount")).alias("q"))
        w = W.partitionBy(*keys).orderBy("filing_date").rowsBetween(W.unboundedPreceding, -1)
        past = day.select(*keys, "filing_date", *[F.sum(c).over(w).alias(f"{c}_{name}") for c in "nsq"])
        x = x.join(past, [*keys, "filing_date"])
        n, mean = F.col(f"n_{name}"), F.col(f"s_{name}") / F.col(f"n_{name}")
        sd = F.sqrt(F.greatest((F.col(f"q_{name}") - n * mean * mean) / (n - 1), F.lit(0.0)))
        level, z = level.when(n >= 5, name), z.when(n >= 5, F.when(sd > 1e-6, (F.col("amount") - mean) / sd).otherwise(0.0))
    return x.select("trade_id", level.alias("level"), F.round(z, 4).alias("z"))


@query("event_drift", """disc, sessions: WITH px AS (SELECT ticker, idx, open, close, lag(close) OVER o AS prev, lead(close) OVER o AS c1, lead(idx) OVER o AS i1, lead(close, 5) OVER o AS c5, lead(idx, 5) OVER o AS i5 FROM prices JOIN sessions USING (date) WINDOW o AS (PARTITION BY ticker ORDER BY idx)),
  b AS (SELECT idx, avg(close) AS m FROM px GROUP BY 1), e AS (SELECT d.trade_id, d.ticker, s.idx AS i FROM disc d ASOF JOIN sessions s ON d.filing_date <= s.date)
  SELECT trade_id, round(px.open / prev - 1, 6) AS gap, round(abs(CASE WHEN i1 = i + 1 THEN c1 / px.open - b1.m / b0.m END), 6) AS abs_1, round(CASE WHEN i5 = i + 5 THEN c5 / px.open - b5.m / b0.m END, 6) AS car_5, round(CASE WHEN i5 = i + 5 THEN (c5 / px.open - 1) * sign(px.open / prev - 1) END, 6) AS signed_drift
  FROM e JOIN px ON px.ticker = e.ticker AND px.idx = i LEFT JOIN b b0 ON b0.idx = i LEFT JOIN b b1 ON b1.idx = i + 1 LEFT JOIN b b5 ON b5.idx = i + 5""")
def event_drift(spark, d):
    """From the open of the first session on or after the event: gap, unsigned and benchmark-adjusted outcomes, drift along the gap. A missing session gives NULL."""
    from tidemark.operators.panel import next_session

    s = t.sessions(spark, d)
    p = t.prices(spark, d).join(s, "date")
    o, days = W.partitionBy("ticker").orderBy("idx"), W.orderBy("idx")  # the second over one row a session
    at = lambda c, k, w=o: F.when(F.lead("idx", k).over(w) == F.col("idx") + k, F.lead(c, k).over(w))
    b = p.groupBy("idx").agg(F.avg("close").alias("m"))
    b = b.select("idx", "m", at("m", 1, days).alias("m1"), at("m", 5, days).alias("m5"))
    px = p.select("ticker", "idx", "open", F.lag("close").over(o).alias("prev"), at("close", 1).alias("c1"), at("close", 5).alias("c5")).join(b, "idx")
    e = t.disclosures(spark, d).join(next_session(s).select(F.col("day").alias("filing_date"), "idx"), "filing_date").select("trade_id", "ticker", "idx").join(px, ["ticker", "idx"])
    gap = F.col("open") / F.col("prev") - 1
    car = lambda k: F.col(f"c{k}") / F.col("open") - F.col(f"m{k}") / F.col("m")
    return e.select("trade_id", R6(gap).alias("gap"), R6(F.abs(car(1))).alias("abs_1"), R6(car(5)).alias("car_5"), R6((F.col("c5") / F.col("open") - 1) * F.sign(gap)).alias("signed_drift"))


@query("daily_context", """disc, rets: WITH p AS (SELECT ticker, date, close, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol, avg(close * volume) OVER w AS adv FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT trade_id, round(close + 1e-7, 4) AS prior_close, round(vol, 6) AS vol20, round(adv + 1e-5, 2) AS adv20 FROM disc ASOF LEFT JOIN p ON p.ticker = disc.ticker AND disc.filing_date > p.date""")
def daily_context(spark, d):
    """Close, volatility and dollar volume as of the last session before the event."""
    w = trailing("ticker", "date", 20, lag=0)
    p = t.returns(t.prices(spark, d)).select("ticker", "date", "close", F.when(F.count("ret").over(w) == 20, F.stddev_samp("ret").over(w)).alias("vol"), F.avg(F.col("close") * F.col("volume")).over(w).alias("adv"))
    e = asof(t.disclosures(spark, d), p, ["ticker"], "filing_date", "date", ["close", "vol", "adv"], strict=True)
    return e.select("trade_id", F.round(F.col("close") + 1e-7, 4).alias("prior_close"), R6("vol").alias("vol20"), F.round(F.col("adv") + 1e-5, 2).alias("adv20"))


@query("matched_controls", """brets: WITH h AS (SELECT *, md5(ticker || '|' || epoch(ts)::BIGINT) AS h FROM brets), r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY h) AS a, row_number() OVER (PARTITION BY ticker, hour(ts) ORDER BY h) AS b FROM h)
  SELECT x.ticker, epoch(x.ts)::BIGINT AS at, o.ticker AS other_ticker, epoch(s.ts)::BIGINT AS same_slot FROM r x LEFT JOIN r o ON o.ts = x.ts AND o.a = CASE WHEN x.a = 1 THEN 2 ELSE 1 END LEFT JOIN r s ON s.ticker = x.ticker AND hour(s.ts) = hour(x.ts) AND s.b = CASE WHEN x.b = 1 THEN 2 ELSE 1 END""")
def matched_controls(spark, d):
    """For each bar another ticker at the same time, and the same ticker at the same hour of another day: the first by hash that is not the bar itself. No pool is joined."""
    x = t.bars(spark, d).select("ticker", F.unix_timestamp("ts").alias("at"), F.hour("ts").alias("slot")).withColumn("h", F.md5(F.concat_ws("|", "ticker", F.col("at").cast("string"))))

    def drawn(keys: list[str], value: str, name: str):
        two = best(x, keys, "h", n=2).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", value))).alias("two"))
        own = F.get("two.h", F.lit(0)) == F.col("h")
        return lambda rows: rows.join(two, keys).withColumn(name, F.get(F.col(f"two.{value}"), F.when(own, 1).otherwise(0))).drop("two")

    x = drawn(["ticker", "slot"], "at", "same_slot")(drawn(["at"], "ticker", "other_ticker")(x))
    return x.select("ticker", "at", "other_ticker", "same_slot")


@query("prediction_metrics", """rets: WITH x AS (SELECT ticker, date, ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) * -0.1::DOUBLE AS p FROM rets), y AS (SELECT *, CASE WHEN abs(p) > 0.001 THEN sign(p) ELSE 0 END AS w FROM x WHERE ret IS NOT NULL AND p IS NOT NULL), z AS (SELECT *, w * ret - abs(w) * 0.001::DOUBLE AS net FROM y), s AS (SELECT stddev_samp(ret - p) AS sg FROM z)
  SELECT ticker, count(*) AS n, count(*) FILTER (WHERE w <> 0) AS trades, round(avg(net) * 10000, 4) AS net_bps, round(avg(CASE WHEN w <> 0 THEN CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END END), 6) AS hit_rate, round(avg(CASE WHEN w <> 0 THEN net END) / stddev_samp(CASE WHEN w <> 0 THEN net END), 6) AS information_ratio,
  round(avg(0.5 * ln(2 * pi() * sg * sg) + 0.5 * ((ret - p) / sg) ** 2), 6) AS gaussian_loss FROM z, s GROUP BY 1""")
def prediction_metrics(spark, d):
    """Trades where the prediction is beyond the cost; net return, hit rate, information ratio and Gaussian loss."""
    x = t.returns(t.prices(spark, d))
    x = x.withColumn("p", F.lag("ret").over(W.partitionBy("ticker").orderBy("date")) * -0.1).where("ret is not null and p is not null")
    x = x.withColumn("w", F.when(F.abs("p") > 0.001, F.sign("p")).otherwise(0.0)).withColumn("net", F.col("w") * F.col("ret") - F.abs("w") * 0.001)
    sigma = x.agg(F.stddev_samp(F.col("ret") - F.col("p")).alias("sg"))  # one row
    active = F.when(F.col("w") != 0, F.col("net"))
    loss = 0.5 * F.log(2 * math.pi * F.col("sg") * F.col("sg")) + 0.5 * F.pow((F.col("ret") - F.col("p")) / F.col("sg"), 2)
    return x.crossJoin(F.broadcast(sigma)).groupBy("ticker").agg(
        F.count("*").alias("n"), F.count(active).alias("trades"), F.round(F.avg("net") * 10000, 4).alias("net_bps"), R6(F.avg(F.when(active > 0, 1.0).when(active <= 0, 0.0))).alias("hit_rate"),
        R6(F.avg(active) / F.stddev_samp(active)).alias("information_ratio"), R6(F.avg(loss)).alias("gaussian_loss"),
    )


@query("day_clustered_sharpe", "brets: WITH x AS (SELECT ticker, CAST(ts AS DATE) AS day, sum(ret) AS r FROM brets WHERE ret IS NOT NULL GROUP BY 1, 2) SELECT ticker, count(*) AS days, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 4) AS sharpe FROM x GROUP BY 1")
def day_clustered_sharpe(spark, d):
    x = t.returns(t.bars(spark, d), at="ts").where("ret is not null").groupBy("ticker", F.to_date("ts").alias("day")).agg(F.sum("ret").alias("r"))
    return x.groupBy("ticker").agg(F.count("*").alias("days"), F.round(F.try_divide(F.avg("r"), F.stddev_samp("r")) * math.sqrt(365), 4).alias("sharpe"))


@query("book_return", """prices: WITH w AS (SELECT ticker, count(*)::DOUBLE AS weight FROM prices GROUP BY 1 UNION ALL SELECT 'UNPRICED', 1000.0::DOUBLE), d AS (SELECT make_date(y::INT, m::INT, 1) AS a, CAST(make_date(y::INT, m::INT, 1) + INTERVAL 1 MONTH AS DATE) AS b FROM (SELECT DISTINCT year(date) AS y, month(date) AS m FROM prices)),
  r AS (SELECT d.a, w.weight, (SELECT arg_min(close, date) FROM prices p WHERE p.ticker = w.ticker AND p.date >= d.b) / (SELECT arg_min(close, date) FROM prices p WHERE p.ticker = w.ticker AND p.date >= d.a) - 1 AS ret FROM d, w)
  SELECT a AS month, round(coalesce(sum(weight * ret) / sum(CASE WHEN ret IS NOT NULL THEN weight END), 0), 6) AS ret FROM r GROUP BY 1""")
def book_return(spark, d):
    """Monthly returns between the first closes on or after both days, over the weights that have both prices."""
    p = t.prices(spark, d).select("ticker", "date", "close")
    w = p.groupBy("ticker").agg(F.count("*").cast("double").alias("weight"))
    months = p.select(F.trunc("date", "month").alias("month")).distinct()
    # a row per ticker and month, as many as there are prices at most
    grid = w.crossJoin(F.broadcast(months)).withColumn("next", F.add_months("month", 1))
    g = asof(grid, p, ["ticker"], "month", "date", ["close"], forward=True, prefix="a_")
    g = asof(g, p, ["ticker"], "next", "date", ["close"], forward=True, prefix="b_")
    ret = F.try_divide("b_close", "a_close") - 1
    return g.groupBy("month").agg(R6(F.coalesce(F.try_divide(F.sum(F.col("weight") * ret), F.sum(F.when(ret.isNotNull(), F.col("weight")))), F.lit(0.0))).alias("ret"))


@query("top_contributions", """SELECT vec_id, CAST(i AS INT) AS feature, round(CAST(v AS DOUBLE), 6) AS contribution FROM (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS r FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) WHERE r <= 3""")
def top_contributions(spark, d):
    """The three largest contributions of each row, by size; ties go to the first feature. No row leaves its partition."""
    parts = F.transform("embedding", lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("feature"), v.cast("double").alias("v")))
    x = load(spark, d, "embeddings").select("vec_id", F.explode(F.slice(F.array_sort(parts), 1, 3)).alias("p"))
    return x.select("vec_id", "p.feature", R6("p.v").alias("contribution"))


@query("crawl_targets", "members: SELECT member, sector FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY sha256(name), member) AS r FROM members) WHERE r <= 20")
def crawl_targets(spark, d):
    """Twenty members of each sector by the hash of their names."""
    return best(t.members(spark, d), ["sector"], F.sha2("name", 256), "member", n=20).select("member", "sector")
