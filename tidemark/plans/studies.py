"""Detectors and replays, portfolios, inference, text, data-quality gates and learning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators import backtest, clusters, inference, panel, portfolio, sequence
from tidemark.operators.asof import within
from tidemark.operators.tables import best
from tidemark.plans import tables as t
from tidemark.registry import query
from tidemark.session import load

R6 = lambda c: F.round(c, 6)
secs = F.unix_timestamp


def returns(spark, d):
    return t.returns(t.prices(spark, d))


CUSUM = "CASE WHEN {x} IS NULL THEN {s} ELSE greatest(0.0::DOUBLE, {s} {sign} {x} - 0.1::DOUBLE) END"


@query("cusum_reset", """brets: WITH RECURSIVE e AS (SELECT ticker, CAST(ts AS DATE) AS day, ts, ret, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) AS i FROM brets),
  k AS (SELECT ticker, day, ts, i, ret, """ + CUSUM.format(x="ret", s="0.0::DOUBLE", sign="+") + " AS up, " + CUSUM.format(x="ret", s="0.0::DOUBLE", sign="-") + """ AS down FROM e WHERE i = 1
   UNION ALL SELECT e.ticker, e.day, e.ts, e.i, e.ret, """ + CUSUM.format(x="e.ret", s="k.up", sign="+") + ", " + CUSUM.format(x="e.ret", s="k.down", sign="-") + """ FROM k JOIN e ON e.ticker = k.ticker AND e.day = k.day AND e.i = k.i + 1)
  SELECT ticker, CAST(epoch(ts) AS BIGINT) AS at, round(CASE WHEN ret >= 0 THEN up WHEN ret < 0 THEN down END, 6) AS cusum FROM k""")
def cusum_reset(spark, d):
    r = t.returns(t.bars(spark, d), at="ts").withColumn("day", F.to_date("ts"))
    return sequence.cusum_by(r, ["ticker", "day"], "ts", "ret", 0.1).select("ticker", secs("ts").alias("at"), R6("cusum").alias("cusum"))


@query("episode_cooldown", """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
  k AS (SELECT user_id, i, s, s AS last, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.s, CASE WHEN floor(e.s) - floor(k.last) >= 86400 THEN e.s ELSE k.last END, floor(e.s) - floor(k.last) >= 86400 FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)
  SELECT user_id, CAST(floor(s) AS BIGINT) AS at FROM k WHERE kept""")
def episode_cooldown(spark, d):
    e = load(spark, d, "events").select("user_id", "ts")
    return sequence.cooldown(e, ["user_id"], "ts", 86400).select("user_id", secs("ts").alias("at"))


BARRIER = """bars: WITH b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS idx FROM bars), e AS (SELECT ticker, idx, CASE WHEN close >= open THEN 1 ELSE -1 END AS side FROM b),
  n AS (SELECT e.*, b.open AS entry FROM e JOIN b ON b.ticker = e.ticker AND b.idx = e.idx + 1 WHERE b.open > 0), j AS (SELECT n.*, b.idx - n.idx AS step, b.close,
   CASE WHEN side > 0 THEN b.high >= entry * 1.5 ELSE b.low <= entry * 0.5 END AS tk, CASE WHEN side > 0 THEN b.low <= entry * 0.5 ELSE b.high >= entry * 1.5 END AS st FROM n JOIN b ON b.ticker = n.ticker AND b.idx BETWEEN n.idx + 1 AND n.idx + 5),
  f AS (SELECT ticker, idx, side, entry, min(CASE WHEN tk OR st THEN step END) AS hit, max(step) AS last FROM j GROUP BY ALL)
  SELECT f.ticker, CAST(f.idx AS INT) AS idx, CAST(coalesce(hit, last) AS INT) AS bars_held, CASE WHEN hit IS NULL THEN 'time' WHEN {first} THEN '{a}' ELSE '{b}' END AS reason FROM f JOIN j ON j.ticker = f.ticker AND j.idx = f.idx AND j.step = coalesce(hit, last)"""


def _barrier(spark, d, stop_first):
    b = t.bars(spark, d).withColumn("idx", F.row_number().over(W.partitionBy("ticker").orderBy("ts")))
    e = b.select("ticker", "idx", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("side"))
    return sequence.barrier(e, b, "ticker", 5, 0.5, 0.5, stop_first).where("entry > 0").select("ticker", "idx", "bars_held", "reason")


@query("triple_barrier", BARRIER.format(first="tk", a="take", b="stop"))
def triple_barrier(spark, d):
    return _barrier(spark, d, False)


@query("triple_barrier_pessimistic", BARRIER.format(first="st", a="stop", b="take"))
def triple_barrier_pessimistic(spark, d):
    return _barrier(spark, d, True)


@query("concurrency_cap")
def concurrency_cap(spark, d):
    """All trades as one book."""
    x = t.disclosures(spark, d).select(F.lit("all").alias("book"), F.col("trade_id").alias("id"), F.col("tx_date").cast("timestamp").alias("s"), F.date_add("tx_date", 20).cast("timestamp").alias("e"))
    return sequence.concurrency_cap(x, ["book"], "s", "e", 5).select("id")


@query("opening_policy_replay", """bars: WITH m AS (SELECT ticker, CAST(ts AS DATE) AS date, arg_min(open, ts) FILTER (WHERE hour(ts) = 9) AS o9, arg_max(close, ts) FILTER (WHERE hour(ts) = 10) AS c10, max(open) FILTER (WHERE hour(ts) = 11) AS entry, max(close) FILTER (WHERE hour(ts) = 15) AS exit FROM bars GROUP BY 1, 2),
  s AS (SELECT *, c10 / nullif(o9, 0) - 1 AS gap FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(gap) DESC, ticker) AS k FROM s WHERE gap IS NOT NULL AND entry > 0 AND exit IS NOT NULL)
  SELECT date, ticker, round(sign(gap) * (exit / entry - 1) - 0.0016, 6) AS net FROM r WHERE k = 1""")
def opening_policy_replay(spark, d):
    b = t.bars(spark, d).withColumns({"date": F.to_date("ts"), "h": F.hour("ts")})
    at = lambda c, h: F.max(F.when(F.col("h") == h, F.col(c)))
    m = b.groupBy("ticker", "date").agg(at("open", 9).alias("o9"), at("close", 10).alias("c10"), at("open", 11).alias("entry"), at("close", 15).alias("exit"))
    m = m.withColumn("gap", F.try_divide("c10", "o9") - 1).where("gap is not null and entry > 0 and exit is not null")
    return best(m, ["date"], F.desc(F.abs("gap")), "ticker").select("date", "ticker", R6(F.signum("gap") * (F.col("exit") / F.col("entry") - 1) - 0.0016).alias("net"))


@query("cap_weights")
def cap_weights(spark, d):
    v = t.prices(spark, d).groupBy(F.year("date").alias("yr"), "ticker").agg(F.sum(F.col("close") * F.col("volume")).alias("v"))
    return portfolio.cap_weights(v, ["yr"], "v", 0.18).select("yr", "ticker", R6("capped").alias("capped"))


@query("construct_sector_cap", """members: WITH s AS (SELECT member, sector, balance, row_number() OVER (PARTITION BY sector ORDER BY balance DESC, member) AS r FROM members) SELECT member, sector FROM s WHERE r <= 4 ORDER BY balance DESC, member LIMIT 15""")
def construct_sector_cap(spark, d):
    return best(t.members(spark, d), ["sector"], F.desc("balance"), "member", n=4).orderBy(F.desc("balance"), "member").limit(15).select("member", "sector")


@query("turnover_cost", """prices: WITH w AS (SELECT ticker, date_trunc('month', date) AS m, sum(close * volume) AS v FROM prices GROUP BY 1, 2), x AS (SELECT ticker, m, v / sum(v) OVER (PARTITION BY m) AS w FROM w),
  mm AS (SELECT m, lead(m) OVER (ORDER BY m) AS nxt FROM (SELECT DISTINCT m FROM x)), c AS (SELECT ticker, nxt AS m, w AS before FROM x JOIN mm USING (m) WHERE nxt IS NOT NULL),
  j AS (SELECT m, sum(abs(coalesce(w, 0) - coalesce(before, 0))) AS t FROM x FULL JOIN c USING (ticker, m) GROUP BY 1) SELECT CAST(m AS DATE) AS m, round(t, 6) AS turnover, round(t * 0.001, 8) AS cost FROM j""")
def turnover_cost(spark, d):
    w = t.prices(spark, d).groupBy("ticker", F.trunc("date", "MM").alias("m")).agg(F.sum(F.col("close") * F.col("volume")).alias("v"))
    w = w.withColumn("w", F.col("v") / F.sum("v").over(W.partitionBy("m"))).select("ticker", "m", "w")
    return portfolio.turnover(w, "ticker", "m", "w").select("m", R6("turnover").alias("turnover"), F.round(F.col("turnover") * 0.001, 8).alias("cost"))


@query("ledger_nav", """rets: WITH p AS (SELECT date, avg(ret) AS r FROM rets WHERE ret IS NOT NULL GROUP BY 1), n AS (SELECT date, r, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS nav FROM p) SELECT date, round(nav, 5) AS nav, round(nav / max(nav) OVER (ORDER BY date) - 1, 5) AS drawdown FROM n""")
def ledger_nav(spark, d):
    p, o = returns(spark, d).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("r")), W.orderBy("date")
    p = p.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(o)))
    return p.select("date", F.round("nav", 5).alias("nav"), F.round(F.col("nav") / F.max("nav").over(o) - 1, 5).alias("drawdown"))


@query("vol_target_ewma", """rets: WITH v AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, CASE WHEN count(ret) OVER b = 60 THEN greatest(stddev_samp(ret) OVER a, stddev_samp(ret) OVER b) END AS vol FROM rets
   WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
  m AS (SELECT ticker, date, i, CASE WHEN vol > 0 THEN least(1.5::DOUBLE, greatest(0.5::DOUBLE, 0.10::DOUBLE / (vol * 15.874507866387544::DOUBLE))) END AS m FROM v)
  SELECT x.ticker, x.date, round(coalesce(sum(y.m * pow(2 / 3.0::DOUBLE, x.i - y.i)) / sum(CASE WHEN y.m IS NOT NULL THEN pow(2 / 3.0::DOUBLE, x.i - y.i) END), 1.0::DOUBLE), 6) AS leverage FROM m x JOIN m y ON y.ticker = x.ticker AND y.i <= x.i GROUP BY 1, 2""")
def vol_target_ewma(spark, d):
    """Leverage from the volatility known the day before: the larger of 20 and 60 days, clipped, smoothed; 1 while there is none."""
    o = W.partitionBy("ticker").orderBy("date")
    sd = lambda n: F.stddev_samp("ret").over(o.rowsBetween(-n, -1))
    r = returns(spark, d).withColumn("vol", F.when(F.count("ret").over(o.rowsBetween(-60, -1)) == 60, F.greatest(sd(20), sd(60))))
    raw = F.try_divide(F.lit(0.10), F.col("vol") * 15.874507866387544)
    r = r.select("ticker", "date", F.when(raw.isNotNull(), F.least(F.lit(1.5), F.greatest(F.lit(0.5), raw))).alias("m"))
    return sequence.ewma_by(r, ["ticker"], "date", "m", 5, "e").select("ticker", "date", R6(F.coalesce(F.nanvl("e", F.lit(None).cast("double")), F.lit(1.0))).alias("leverage"))


@query("forward_settle_mark", """disc, sessions: WITH e AS (SELECT d.trade_id, d.ticker, s.idx AS i FROM (SELECT * FROM disc WHERE tx_type = 'PURCHASE') d ASOF JOIN sessions s ON d.filing_date < s.date), px AS (SELECT ticker, idx, open, close FROM prices JOIN sessions USING (date))
  SELECT trade_id, CASE WHEN b.close IS NOT NULL THEN 'CLOSED' WHEN a.open IS NOT NULL THEN 'OPEN' ELSE 'UNFILLED' END AS status, round(b.close / nullif(a.open, 0) - 1, 6) AS ret FROM e LEFT JOIN px a ON a.ticker = e.ticker AND a.idx = i LEFT JOIN px b ON b.ticker = e.ticker AND b.idx = i + 63""")
def forward_settle_mark(spark, d):
    p, s = t.prices(spark, d), t.sessions(spark, d)
    e = t.disclosures(spark, d).where("tx_type = 'PURCHASE'").select("trade_id", "ticker", "filing_date").join(panel.next_session(s, strict=True).select(F.col("day").alias("filing_date"), F.col("idx").alias("i")), "filing_date")
    px = p.join(s, "date")
    e = e.join(px.select("ticker", F.col("idx").alias("i"), "open"), ["ticker", "i"], "left").join(px.select("ticker", (F.col("idx") - 63).alias("i"), "close"), ["ticker", "i"], "left")
    return e.select("trade_id", F.when(F.col("close").isNotNull(), "CLOSED").when(F.col("open").isNotNull(), "OPEN").otherwise("UNFILLED").alias("status"), R6(F.try_divide("close", "open") - 1).alias("ret"))


@query("eb_shrink", """disc: WITH g AS (SELECT member, count(amount) AS n, avg(amount / 1000) AS raw, var_samp(amount / 1000) AS v FROM disc GROUP BY 1), a AS (SELECT var_samp(amount / 1000) AS pv, avg(amount / 1000) AS grand FROM disc),
  h AS (SELECT *, CASE WHEN n >= 5 THEN v ELSE pv END / n AS se2 FROM g, a), k AS (SELECT greatest(1e-6::DOUBLE, sum(n * (raw - grand) ** 2) / sum(n) - avg(se2)) AS tau2 FROM h)
  SELECT member, n, round(raw, 3) AS raw, round(tau2 / (tau2 + se2) * raw + (1 - tau2 / (tau2 + se2)) * grand, 3) AS shrunk FROM h, k""")
def eb_shrink(spark, d):
    x = t.disclosures(spark, d).withColumn("x", F.col("amount") / 1000)
    return inference.eb_shrink(x, "member", "x").select("member", "n", F.round("raw", 3).alias("raw"), F.round("shrunk", 3).alias("shrunk"))


@query("hac_stats", """rets: WITH x AS (SELECT ticker, date, ret, ret - avg(ret) OVER (PARTITION BY ticker) AS e FROM rets WHERE ret IS NOT NULL), l AS (SELECT *, """ + ", ".join(f"e * lag(e, {k}) OVER (PARTITION BY ticker ORDER BY date) AS g{k}" for k in range(1, 6)) + """ FROM x)
  SELECT ticker, count(*) AS n, round(avg(ret), 7) AS mean, round(avg(ret) / sqrt(greatest(0.0::DOUBLE, (sum(e * e) + """ + " + ".join(f"2 * (1 - {k} / 6.0::DOUBLE) * sum(g{k})" for k in range(1, 6)) + """) / count(*)) / count(*)), 4) AS t FROM l GROUP BY 1""")
def hac_stats(spark, d):
    return inference.hac(returns(spark, d).where("ret is not null"), ["ticker"], "date", "ret", 5).select("ticker", "n", F.round("mean", 7).alias("mean"), F.round("t", 4).alias("t"))


#: Trials of which the best is judged, and the factor of their spread that the best of them reaches without skill.
TRIALS = 20
BEST = inference.expected_max_sharpe(1.0, TRIALS)


@query("deflated_sharpe", """rets: WITH m AS (SELECT ticker, count(ret) AS n, avg(ret) AS a, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp, kurtosis_pop(ret) + 3 AS kurt, avg(ret * ret * ret) AS m3, avg(ret * ret) AS m2 FROM rets GROUP BY 1),
  s AS (SELECT *, a / sd AS sr, (m3 - 3 * a * m2 + 2 * a * a * a) / (sp * sp * sp) AS skew FROM m) SELECT ticker, n, round(sr, 6) AS sr, round(skew, 4) AS skew, round(kurt, 4) AS kurt, round((sr - stddev_samp(sr) OVER () * """ + repr(BEST) + """::DOUBLE) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr), 4) AS z FROM s""")
def deflated_sharpe(spark, d):
    m = returns(spark, d).groupBy("ticker").agg(*inference.sharpe_moments("ret"))
    m = m.crossJoin(F.broadcast(m.agg(F.stddev_samp("sr").alias("spread"))))  # one row
    z = (F.col("sr") - BEST * F.col("spread")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr"))
    return m.select("ticker", "n", R6("sr").alias("sr"), F.round("skew", 4).alias("skew"), F.round("kurt", 4).alias("kurt"), F.round(z, 4).alias("z"))


@query("probabilistic_sharpe")
def probabilistic_sharpe(spark, d):
    m = returns(spark, d).groupBy("ticker").agg(*inference.sharpe_moments("ret"))
    null = inference.expected_max_sharpe(0.0004, 6)
    return m.select("ticker", R6(inference.probabilistic_sharpe(F.col("sr"), 0.0, F.col("n"), F.col("skew"), F.col("kurt"))).alias("psr"), R6(inference.probabilistic_sharpe(F.col("sr"), null, F.col("n"), F.col("skew"), F.col("kurt"))).alias("dsr"))


WEIGHT = lambda c, seed: "(" + " + ".join(f"CASE WHEN ('0x' || substr(md5('{seed}|' || draw || '|' || CAST({c} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in inference.POISSON) + ")"
DRAWS = 200


@query("cluster_bootstrap", f"""disc: WITH g AS (SELECT member, sum(amount) AS s, count(amount) AS c FROM disc GROUP BY 1), w AS (SELECT draw, s, c, {WEIGHT("member", 7)} AS w FROM g, unnest(range(1, {DRAWS + 1})) AS u(draw)),
  m AS (SELECT sum(w * s) / sum(w * c) AS m FROM w GROUP BY draw) SELECT (SELECT count(amount) FROM disc) AS n, round((SELECT avg(amount) FROM disc), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m""")
def cluster_bootstrap(spark, d):
    got = inference.cluster_bootstrap(t.disclosures(spark, d), "member", "amount", draws=DRAWS)
    return got.select("n", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])


@query("two_way_bootstrap", f"""disc: WITH g AS (SELECT member, year(filing_date) AS yr, sum(amount) AS s, count(amount) AS c FROM disc GROUP BY 1, 2), w AS (SELECT draw, s, c, {WEIGHT("member", 23)} * {WEIGHT("yr", 24)} AS w FROM g, unnest(range(1, {DRAWS + 1})) AS u(draw)),
  m AS (SELECT sum(w * s) / nullif(sum(w * c), 0) AS m FROM w GROUP BY draw HAVING sum(w) > 0) SELECT (SELECT count(amount) FROM disc) AS n, round((SELECT avg(amount) FROM disc), 3) AS mean, round(quantile_cont(m, 0.025), 3) AS low, round(quantile_cont(m, 0.975), 3) AS high FROM m""")
def two_way_bootstrap(spark, d):
    x = t.disclosures(spark, d).withColumn("yr", F.year("filing_date"))
    got = inference.two_way_bootstrap(x, "member", "yr", "amount", draws=DRAWS)
    return got.select("n", *[F.round(c, 3).alias(c) for c in ("mean", "low", "high")])


@query("block_bootstrap")
def block_bootstrap(spark, d):
    p = returns(spark, d).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("r"))
    return inference.block_bootstrap(p, "date", "r")


@query("spearman_persistence", """disc: WITH y AS (SELECT member, year(filing_date) AS yr, avg(amount) AS a FROM disc GROUP BY 1, 2), j AS (SELECT x.yr, x.a AS a0, z.a AS a1 FROM y x JOIN y z ON z.member = x.member AND z.yr = x.yr + 1),
  r AS (SELECT yr, rank() OVER (PARTITION BY yr ORDER BY a0) + (count(*) OVER (PARTITION BY yr, a0) - 1) / 2.0::DOUBLE AS r0, rank() OVER (PARTITION BY yr ORDER BY a1) + (count(*) OVER (PARTITION BY yr, a1) - 1) / 2.0::DOUBLE AS r1 FROM j) SELECT yr, count(*) AS n, round(corr(r0, r1), 6) AS rho FROM r GROUP BY 1""")
def spearman_persistence(spark, d):
    y = t.disclosures(spark, d).groupBy("member", F.year("filing_date").alias("yr")).agg(F.avg("amount").alias("a"))
    j = y.join(y.select("member", (F.col("yr") - 1).alias("yr"), F.col("a").alias("later")), ["member", "yr"])
    j = j.withColumns({"r0": panel.average_rank("a", "yr"), "r1": panel.average_rank("later", "yr")})
    return j.groupBy("yr").agg(F.count("*").alias("n"), R6(F.corr("r0", "r1")).alias("rho"))


@query("quartile_transition", """disc: WITH y AS (SELECT member, year(filing_date) AS yr, avg(amount) AS a FROM disc GROUP BY 1, 2), q AS (SELECT yr, quantile_cont(a, 0.25) AS lo, quantile_cont(a, 0.75) AS hi FROM y GROUP BY 1)
  SELECT y.yr, CASE WHEN y.a <= lo THEN 'bottom' ELSE 'top' END AS part, count(*) AS n, round(avg(z.a), 4) AS later FROM y JOIN q USING (yr) JOIN y z ON z.member = y.member AND z.yr = y.yr + 1 WHERE y.a <= lo OR y.a >= hi GROUP BY 1, 2""")
def quartile_transition(spark, d):
    y = t.disclosures(spark, d).groupBy("member", F.year("filing_date").alias("yr")).agg(F.avg("amount").alias("a"))
    q = y.groupBy("yr").agg(F.percentile("a", 0.25).alias("lo"), F.percentile("a", 0.75).alias("hi"))
    j = y.join(q, "yr").where("a <= lo or a >= hi").join(y.select("member", (F.col("yr") - 1).alias("yr"), F.col("a").alias("later")), ["member", "yr"])
    return j.groupBy("yr", F.when(F.col("a") <= F.col("lo"), "bottom").otherwise("top").alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("later"), 4).alias("later"))


@query("winsor_z_train_only", """disc: WITH f AS (SELECT quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM disc WHERE filing_date < DATE '1996-01-01'), s AS (SELECT avg(greatest(lo, least(hi, amount))) AS m, stddev_samp(greatest(lo, least(hi, amount))) AS sd, any_value(lo) AS lo, any_value(hi) AS hi FROM disc, f WHERE filing_date < DATE '1996-01-01')
  SELECT trade_id, round((greatest(lo, least(hi, amount)) - m) / sd, 5) AS z FROM disc, s""")
def winsor_z_train_only(spark, d):
    x = t.disclosures(spark, d)
    train = x.where("filing_date < date'1996-01-01'")
    f = train.agg(F.percentile("amount", 0.01).alias("lo"), F.percentile("amount", 0.99).alias("hi"))
    held = F.greatest("lo", F.least("hi", "amount"))
    s = train.crossJoin(f).agg(F.avg(held).alias("m"), F.stddev_samp(held).alias("sd")).crossJoin(f)
    return x.crossJoin(s).select("trade_id", F.round((held - F.col("m")) / F.col("sd"), 5).alias("z"))


@query("multiway_cov", """disc: WITH s AS (SELECT member, ticker, (amount - avg(amount) OVER ()) / 1000 AS e FROM disc WHERE ticker IS NOT NULL), a AS (SELECT sum(v * v) AS x FROM (SELECT sum(e) AS v FROM s GROUP BY member)), b AS (SELECT sum(v * v) AS x FROM (SELECT sum(e) AS v FROM s GROUP BY ticker)), c AS (SELECT sum(v * v) AS x FROM (SELECT sum(e) AS v FROM s GROUP BY member, ticker))
  SELECT round((a.x + b.x - c.x) / 1e6, 4) AS meat FROM a, b, c""")
def multiway_cov(spark, d):
    x = t.disclosures(spark, d).where("ticker is not null")
    x = x.crossJoin(x.agg(F.avg("amount").alias("m"))).withColumn("e", (F.col("amount") - F.col("m")) / 1000)
    return inference.multiway_meat(x, [["member"], ["ticker"]], [("e", "e")]).select(F.round(F.col("e_e") / 1e6, 4).alias("meat"))


@query("permutation_blocks")
def permutation_blocks(spark, d):
    return inference.permuted(t.disclosures(spark, d).select("trade_id", "tx_type", "amount"), ["tx_type"], "amount", "trade_id")


@query("matched_strata", """disc, members: WITH g AS (SELECT sector, tx_type, region, avg(amount) AS a, count(*) AS n FROM disc JOIN members USING (member) GROUP BY 1, 2, 3) SELECT x.sector, x.tx_type, x.region AS one, y.region AS two, round(x.a - y.a, 3) AS diff FROM g x JOIN g y ON x.sector = y.sector AND x.tx_type = y.tx_type AND x.region < y.region WHERE x.n >= 5 AND y.n >= 5""")
def matched_strata(spark, d):
    g = t.disclosures(spark, d).join(t.members(spark, d), "member").groupBy("sector", "tx_type", "region").agg(F.avg("amount").alias("a"), F.count("*").alias("n")).where("n >= 5")
    side = lambda n: g.select("sector", "tx_type", F.col("region").alias(n), F.col("a").alias(f"a_{n}"))
    return side("one").join(side("two"), ["sector", "tx_type"]).where("one < two").select("sector", "tx_type", "one", "two", F.round(F.col("a_one") - F.col("a_two"), 3).alias("diff"))


@query("factor_regression", """rets: WITH m AS (SELECT date, avg(ret) AS mkt FROM rets WHERE ret IS NOT NULL GROUP BY 1) SELECT ticker, round(regr_slope(ret, mkt), 5) AS beta, round(regr_intercept(ret, mkt), 7) AS alpha, round(regr_r2(ret, mkt), 5) AS r2, regr_count(ret, mkt)::BIGINT AS n FROM rets JOIN m USING (date) GROUP BY 1""")
def factor_regression(spark, d):
    r = returns(spark, d).where("ret is not null")
    r = r.join(r.groupBy("date").agg(F.avg("ret").alias("mkt")), "date")
    return r.groupBy("ticker").agg(F.round(F.regr_slope("ret", "mkt"), 5).alias("beta"), F.round(F.regr_intercept("ret", "mkt"), 7).alias("alpha"), F.round(F.regr_r2("ret", "mkt"), 5).alias("r2"), F.regr_count("ret", "mkt").alias("n"))


@query("sharpe_segments", "rets: SELECT ticker, year(date) AS yr, round(avg(ret) / stddev_pop(ret) * sqrt(252), 4) AS sharpe, round(exp(sum(ln(1 + ret))) - 1, 5) AS total FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 20")
def sharpe_segments(spark, d):
    g = returns(spark, d).where("ret is not null").groupBy("ticker", F.year("date").alias("yr"))
    g = g.agg(F.count("*").alias("n"), F.round(F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(252.0)), 4).alias("sharpe"), F.round(F.exp(F.sum(F.log1p("ret"))) - 1, 5).alias("total"))
    return g.where("n > 20").drop("n")


@query("auc_by_rank", "SELECT round((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc FROM (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r, sum(y) OVER () AS n1, sum(1 - y) OVER () AS n0 FROM (SELECT quality AS y, n_chars % 1000 AS s FROM labels JOIN documents USING (doc_id))) GROUP BY n1, n0")
def auc_by_rank(spark, d):
    x = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") % 1000).alias("s"))
    # ranks from counts per value: the window runs over distinct scores
    g = x.groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("c"))
    g = g.withColumn("r", F.coalesce(F.sum("c").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + (F.col("c") + 1) / 2)
    a = g.agg(F.sum(F.col("p") * F.col("r")).alias("rs"), F.sum("p").alias("n1"), F.sum(F.col("c") - F.col("p")).alias("n0"))
    return a.select(R6((F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


@query("aggressor_class", """quotes: WITH p AS (SELECT *, lag(value) OVER (PARTITION BY ticker ORDER BY ts) AS prev, lag(bid) OVER (PARTITION BY ticker ORDER BY ts) AS b, lag(ask) OVER (PARTITION BY ticker ORDER BY ts) AS a FROM quotes)
  SELECT event_id, CASE WHEN b >= a THEN NULL WHEN value >= a THEN 'BUY' WHEN value <= b THEN 'SELL' WHEN value > (a + b) / 2 THEN 'BUY' WHEN value < (a + b) / 2 THEN 'SELL' WHEN value > prev THEN 'BUY' WHEN value < prev THEN 'SELL' END AS side FROM p""")
def aggressor_class(spark, d):
    o = W.partitionBy("ticker").orderBy("ts")
    q = t.quotes(spark, d).withColumns({c: F.lag(v).over(o) for c, v in (("prev", "value"), ("b", "bid"), ("a", "ask"))})
    return q.select("event_id", market.aggressor(F.col("value"), F.col("b"), F.col("a"), F.col("prev")).alias("side"))


@query("fill_sim", """quotes: SELECT event_id, CASE WHEN NOT (ask <= value * 1.002 AND bid > 0 AND ask >= bid) THEN 'REJECTED' WHEN k * 10 >= 200 THEN 'FILLED' WHEN k > 0 THEN 'PARTIAL' ELSE 'REJECTED' END AS status, CASE WHEN ask <= value * 1.002 AND bid > 0 AND ask >= bid THEN least(200, k * 10) ELSE 0 END AS filled FROM quotes""")
def fill_sim(spark, d):
    q = t.quotes(spark, d)
    f = market.fill(F.lit("BUY"), F.lit(200), F.col("value") * 1.002, F.col("bid"), F.col("k") * 10, F.col("ask"), F.col("k") * 10)
    return q.select("event_id", f.alias("f")).select("event_id", "f.status", "f.filled")


@query("cost_model", "quotes: SELECT event_id, round((ask - bid) / ((ask + bid) / 2) * 10000 + 20 * sqrt(value / 1e6), 4) AS bps FROM quotes WHERE bid > 0 AND ask > bid")
def cost_model(spark, d):
    q = t.quotes(spark, d).where("bid > 0 and ask > bid")
    return q.select("event_id", F.round(market.round_trip_cost_bps(market.spread_bps(F.col("bid"), F.col("ask")), F.col("value"), F.lit(1e6)), 4).alias("bps"))


@query("quote_audit", "quotes: SELECT ticker, count(*) FILTER (WHERE bid > ask) AS crossed, count(*) FILTER (WHERE bid = ask) AS locked, count(*) FILTER (WHERE bid <= 0) AS non_positive, count(*) AS n FROM quotes GROUP BY 1")
def quote_audit(spark, d):
    bad = lambda c, n: F.count_if(F.expr(c)).alias(n)
    return t.quotes(spark, d).groupBy("ticker").agg(bad("bid > ask", "crossed"), bad("bid = ask", "locked"), bad("bid <= 0", "non_positive"), F.count("*").alias("n"))


@query("order_audit", "SELECT event_type AS ticker, count(*) FILTER (WHERE ts < p) AS backwards, count(*) FILTER (WHERE ts = p) AS ties FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1")
def order_audit(spark, d):
    """Times against the order of arrival, which is never sorted away."""
    e = load(spark, d, "events").withColumn("p", F.lag("ts").over(W.partitionBy("event_type").orderBy("event_id")))
    return e.groupBy(F.col("event_type").alias("ticker")).agg(F.count_if(F.col("ts") < F.col("p")).alias("backwards"), F.count_if(F.col("ts") == F.col("p")).alias("ties"))


@query("manifest_reject", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_totalprice <= 0 THEN 'BAD_VALUE' WHEN o_orderdate >= TIMESTAMP '1998-06-01' THEN 'AFTER_CUTOFF' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'OUT_OF_VOCABULARY' ELSE 'OK' END AS reason FROM orders) GROUP BY 1""")
def manifest_reject(spark, d):
    why = F.when(F.col("o_totalprice") <= 0, "BAD_VALUE").when(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp"), "AFTER_CUTOFF").when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "OUT_OF_VOCABULARY").otherwise("OK")
    return load(spark, d, "orders").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("pick_canonical", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY CASE WHEN n_chars > 2000 THEN 0 WHEN n_chars > 500 THEN 1 ELSE 2 END, sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r = 1")
def pick_canonical(spark, d):
    tier = F.when(F.col("n_chars") > 2000, 0).when(F.col("n_chars") > 500, 1).otherwise(2)
    return best(load(spark, d, "documents"), ["source", "lang"], tier, F.sha2(F.col("doc_id").cast("string"), 256)).select("source", "doc_id")


@query("dup_revisions", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 'CANONICAL' ELSE 'DUPLICATE' END AS status FROM orders")
def dup_revisions(spark, d):
    w = W.partitionBy("o_custkey", F.to_date("o_orderdate")).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.when(F.row_number().over(w) == 1, "CANONICAL").otherwise("DUPLICATE").alias("status"))


@query("strat_sample", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_name), c_custkey) AS r FROM customer) WHERE r <= 4")
def strat_sample(spark, d):
    return best(load(spark, d, "customer"), ["c_mktsegment"], F.sha2("c_name", 256), "c_custkey", n=4).select("c_custkey", "c_mktsegment")


@query("purged_cv", """disc: WITH b AS (SELECT DATE '1995-01-01' AS s, 1 AS fold UNION ALL SELECT DATE '1996-01-01', 2 UNION ALL SELECT DATE '1997-01-01', 3), v AS (SELECT fold, s, member FROM disc, b WHERE filing_date >= s AND filing_date < s + INTERVAL 1 YEAR GROUP BY ALL)
  SELECT b.fold, count(*) FILTER (WHERE filing_date >= b.s AND filing_date < b.s + INTERVAL 1 YEAR) AS validation, count(*) FILTER (WHERE filing_date < b.s - 20 AND v.member IS NULL) AS train FROM disc d CROSS JOIN b LEFT JOIN v ON v.fold = b.fold AND v.member = d.member GROUP BY 1""")
def purged_cv(spark, d):
    """Forward folds: members of the validation year and rows within 20 days of it are purged from training."""
    x = t.disclosures(spark, d)
    f = x.withColumn("b", F.explode(F.array(*[F.struct(F.lit(f"{y}-01-01").cast("date").alias("s"), F.lit(k).alias("fold")) for k, y in ((1, 1995), (2, 1996), (3, 1997))]))).select("*", "b.*")
    inside = (F.col("filing_date") >= F.col("s")) & (F.col("filing_date") < F.add_months("s", 12))
    v = f.where(inside).select("fold", "member").distinct().withColumn("hit", F.lit(True))
    j = f.join(v, ["fold", "member"], "left")
    return j.groupBy("fold").agg(F.count_if(inside).alias("validation"), F.count_if((F.col("filing_date") < F.date_sub("s", 20)) & F.col("hit").isNull()).alias("train"))


@query("event_tagger", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license') THEN 'license' WHEN regexp_matches(text, '@') THEN 'contact' WHEN regexp_matches(text, 'token = ') THEN 'secret' ELSE 'none' END AS tag, strpos(lower(text), 'license') AS at FROM documents""")
def event_tagger(spark, d):
    x = F.col("text")
    tag = F.when(F.lower(x).contains("license"), "license").when(x.contains("@"), "contact").when(x.contains("token = "), "secret").otherwise("none")
    return load(spark, d, "documents").select("doc_id", tag.alias("tag"), F.locate("license", F.lower(x)).cast("long").alias("at"))


@query("near_dup_pairs", """headlines: WITH k AS (SELECT event_id, public_time, list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM headlines)
  SELECT a.event_id AS one, b.event_id AS two FROM k a JOIN k b ON a.event_id < b.event_id AND abs(epoch(b.public_time) - epoch(a.public_time)) <= 43200 WHERE len(list_intersect(a.w, b.w)) >= 1 AND len(list_intersect(a.w, b.w)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.8""")
def near_dup_pairs(spark, d):
    """Headlines alike within 12 hours. Of n distinct words a headline is looked up by its n - ceil(0.8 n) + 1 rarest: two of Jaccard 0.8 share one of these."""
    h = t.headlines(spark, d).select("event_id", "public_time", text.tokens(F.col("title")).alias("w")).where(F.size("w") > 0)
    words = h.select("event_id", F.explode(F.array_distinct("w")).alias("word"))
    words = words.join(words.groupBy("word").agg(F.count("*").alias("c")), "word")
    ranked = words.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("c", "word"))).alias("r"))
    keys = ranked.select("event_id", F.explode(F.slice("r", F.lit(1), F.size("r") - F.ceil(F.size("r") * 0.8 - 1e-9).cast("int") + 1)).alias("k")).select("event_id", F.col("k.word").alias("word"))
    keys = keys.join(h.select("event_id", "public_time"), "event_id")
    side = lambda n: keys.select("word", F.col("event_id").alias(n), F.col("public_time").alias(f"t_{n}"))
    pairs = within(side("one"), side("two"), ["word"], "t_one", "t_two", 43200, 43200).where("one < two").select("one", "two").distinct()
    pairs = pairs.join(h.select(F.col("event_id").alias("one"), F.col("w").alias("w_one")), "one").join(h.select(F.col("event_id").alias("two"), F.col("w").alias("w_two")), "two")
    return pairs.where(text.jaccard(F.col("w_one"), F.col("w_two")) >= 0.8).select("one", "two")


@query("entity_extract")
def entity_extract(spark, d):
    """Names in the whole headlines, each once."""
    h = t.headlines(spark, d).select("event_id", F.explode(clusters.entities(F.col("title"), F.array("publisher"))).alias("entity"))
    return h.select("event_id", "entity")


@query("catalyst_clusters")
def catalyst_clusters(spark, d):
    """Headlines as articles of their publisher, who also stands for the ticker."""
    h = t.headlines(spark, d).select("event_id", F.lit(None).cast("string").alias("identity"), "public_time", "title", F.array("publisher").alias("tickers"))
    x = clusters.catalysts(h)
    return x.select("catalyst_id", "event_id", secs("public_time").alias("at"), secs("earliest").alias("earliest"))


@query("carhart_car")
def carhart_car(spark, d):
    """Abnormal returns of the purchases over 20 sessions from the one after their filing. Factors: the market, and the lower less the upper half by turnover, price and momentum known the day before."""
    o, day = W.partitionBy("ticker").orderBy("date"), W.partitionBy("date")
    r = returns(spark, d).join(t.sessions(spark, d), "date")
    known = {"smb": F.lag(F.col("close") * F.col("volume")).over(o), "hml": F.lag("close").over(o), "mom": -F.try_divide(F.lag("close").over(o), F.lag("close", 21).over(o))}
    r = r.withColumns(known)
    r = r.withColumns({k: F.when(F.col(k).isNotNull(), F.percent_rank().over(day.orderBy(F.col(k).asc_nulls_last(), "ticker"))) for k in known})
    spread = lambda k: (F.avg(F.when(F.col(k) < 0.5, F.col("ret"))) - F.avg(F.when(F.col(k) >= 0.5, F.col("ret")))).alias(k)
    f = r.groupBy("idx").agg(F.avg("ret").alias("mkt"), *[spread(k) for k in known], F.lit(0.0).alias("rf"))
    cars = panel.factor_car(r.drop(*known).join(f, "idx"), ["mkt", *known], 20).select("ticker", "idx", "car")
    e = t.disclosures(spark, d).where("tx_type = 'PURCHASE'").select("trade_id", "ticker", "filing_date")
    e = e.join(panel.next_session(t.sessions(spark, d), strict=True).select(F.col("day").alias("filing_date"), "idx"), "filing_date")
    return e.join(cars, ["ticker", "idx"], "left").select("trade_id", R6("car").alias("car"))


def _rule_positions(spark, d):
    """Purchases as candidates of three books: all of them, those above 100,000, and all but the building sector's."""
    e = t.disclosures(spark, d).where("tx_type = 'PURCHASE'").join(t.members(spark, d).select("member", "sector"), "member")
    e = e.join(panel.next_session(t.sessions(spark, d), strict=True).select(F.col("day").alias("filing_date"), F.col("idx").alias("ready")), "filing_date")
    books = F.array_compact(F.array(F.lit("all"), F.when(F.col("amount") > 100_000, "large"), F.when(F.col("sector") != "BUILDING", "without")))
    c = e.select(F.explode(books).alias("book"), "ticker", "ready", F.col("amount").alias("priority"))
    opens = t.prices(spark, d).join(t.sessions(spark, d), "date").select("ticker", "idx", "open")
    return backtest.admit(c, opens, ["book"], 3), opens


@query("rule_backtest")
def rule_backtest(spark, d):
    positions, opens = _rule_positions(spark, d)
    x = backtest.nav(positions, opens, t.sessions(spark, d), ["book"], 3, 10.0)
    return x.select("book", "idx", R6("ret").alias("ret"), R6("turnover").alias("turnover"), R6("equity").alias("equity"))


@query("html_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    return load(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))


@query("verbatim_evidence", "SELECT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, text, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS h FROM benchmark) b ON contains(d.text, b.text)")
def verbatim_evidence(spark, d):
    """Benchmark texts that stand word for word in a document, found by an equi-join on their first three words."""
    docs = load(spark, d, "documents").select("doc_id", "text").withColumn("w", F.split("text", "[ \n]"))
    seeds = docs.select("doc_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.slice("w", i + 1, 3))))).alias("h"))
    b = load(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), F.concat_ws(" ", F.slice(F.split("text", "[ \n]"), 1, 3)).alias("h"))
    return seeds.join(F.broadcast(b) if b.count() < 100_000 else b, "h").where(F.expr("contains(text, item)")).select("doc_id", "item_id").distinct()


@query("guidance_link")
def guidance_link(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, "WITHDRAWN").when(F.col("o_orderkey") % 5 == 0, "REAFFIRMED").otherwise("STATED").alias("action"))
    x = sequence.carry_links(o, ["o_custkey"], "o_orderdate", "o_totalprice", "action")
    return x.select("o_orderkey", "action", F.round("previous", 2).alias("previous"), R6("revision").alias("revision"))


@query("transcript_monotone", "SELECT conv_id, count(*) FILTER (WHERE turn <= p) AS disorder, count(*) AS n FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role) AS p FROM conversations) GROUP BY 1")
def transcript_monotone(spark, d):
    c = load(spark, d, "conversations").withColumn("p", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn", "role")))
    return c.groupBy("conv_id").agg(F.count_if(F.col("turn") <= F.col("p")).alias("disorder"), F.count("*").alias("n"))
