"""As-of joins, trailing windows, event returns, cross sections and strategy panels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators import panel, portfolio
from tidemark.operators.asof import asof, within
from tidemark.operators.tables import best
from tidemark.plans import tables as t
from tidemark.registry import query
from tidemark.session import load

R6 = lambda c: F.round(c, 6)


def secs(c):
    return F.unix_timestamp(c)


@query("screen_past_z", """brets: WITH z AS (SELECT *, count(ret) OVER w AS n, avg(ret) OVER w AS m, stddev_pop(ret) OVER w AS sd, lead(close) OVER (PARTITION BY ticker ORDER BY ts) / nullif(close, 0) - 1 AS fwd FROM brets
  WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), f AS (SELECT ticker, CASE WHEN n = 20 AND sd > 0 THEN (ret - m) / sd END AS z, fwd FROM z)
  SELECT ticker, count(*) AS n, round(avg(-sign(z) * fwd) * 10000, 4) AS mean_bps FROM f WHERE abs(z) > 1.5 AND fwd IS NOT NULL GROUP BY 1""")
def screen_past_z(spark, d):
    """Bars, returns, z against the past, and what followed: the flagship screen."""
    r = t.returns(t.bars(spark, d), at="ts")
    r = r.withColumns({"z": panel.past_z("ret", "ticker", "ts", 20), "fwd": F.try_divide(F.lead("close").over(W.partitionBy("ticker").orderBy("ts")), "close") - 1})
    hit = r.where((F.abs("z") > 1.5) & F.col("fwd").isNotNull())
    return hit.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg(-F.signum("z") * F.col("fwd")) * 10000, 4).alias("mean_bps"))


@query("past_z", """brets: SELECT ticker, epoch(ts)::BIGINT AS at, round(CASE WHEN count(ret) OVER w = 20 AND stddev_pop(ret) OVER w > 0 THEN (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w END, 5) AS z FROM brets
  WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def past_z(spark, d):
    return t.returns(t.bars(spark, d), at="ts").select("ticker", secs("ts").alias("at"), F.round(panel.past_z("ret", "ticker", "ts", 20), 5).alias("z"))


ASOF = "quotes, bars: SELECT q.event_id, round(b.close, 6) AS px FROM quotes q ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND b.ts {op} q.ts"


@query("asof_known_close", "bars: SELECT e.event_id, round(b.close, 6) AS px FROM events e ASOF LEFT JOIN bars b ON e.event_type = b.ticker AND e.ts - INTERVAL 1 HOUR > b.ts")
def asof_known_close(spark, d):
    """The close of the last bar that ended before the event: bars are known one hour after they start."""
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("ticker"), "ts")
    b = t.bars(spark, d).withColumn("known", F.col("ts") + F.expr("interval 1 hour"))
    return asof(e, b, ["ticker"], "ts", "known", ["close"], strict=True).select("event_id", R6("close").alias("px"))


@query("asof_next_open", "bars: SELECT e.event_id, round(b.open, 6) AS px FROM events e ASOF LEFT JOIN bars b ON e.event_type = b.ticker AND e.ts <= b.ts")
def asof_next_open(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("ticker"), "ts")
    return asof(e, t.bars(spark, d), ["ticker"], "ts", "ts", ["open"], forward=True).select("event_id", R6("open").alias("px"))


@query("asof_quote_tolerance", """quotes: SELECT b.user_id, b.event_id, CASE WHEN epoch(b.ts) - epoch(q.ts) <= 1800 THEN round(q.bid, 6) END AS bid FROM quotes b ASOF LEFT JOIN (SELECT * FROM quotes WHERE bid > 0 AND ask >= bid AND ticker = 'view') q ON b.user_id = q.user_id AND q.ts < b.ts WHERE b.ticker = 'purchase'""")
def asof_quote_tolerance(spark, d):
    """The last valid quote strictly before, if it is at most half an hour old."""
    q = t.quotes(spark, d)
    left = q.where("ticker = 'purchase'").select("user_id", "event_id", "ts")
    return asof(left, q.where("ticker = 'view'"), ["user_id"], "ts", "ts", ["bid", "ask"], strict=True, tolerance=1800, where=(F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))).select("user_id", "event_id", R6("bid").alias("bid"))


@query("nearest_within_3d", """SELECT e.event_id, arg_min(p.event_id, (abs(epoch(e.ts) - epoch(p.ts)), p.event_id)) AS nearest FROM events e JOIN events p ON e.user_id = p.user_id AND abs(epoch(e.ts) - epoch(p.ts)) <= 3 * 86400
  WHERE e.event_type = 'signup' AND p.event_type = 'purchase' GROUP BY 1""")
def nearest_within_3d(spark, d):
    e = load(spark, d, "events")
    a = e.where("event_type = 'signup'").select("user_id", "event_id", "ts")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("ts").alias("pts"))
    pairs = within(a, b, ["user_id"], "ts", "pts", 3 * 86400, 3 * 86400)
    return pairs.groupBy("event_id").agg(F.min_by("pid", F.struct(F.abs(secs("ts") - secs("pts")).alias("g"), "pid")).alias("nearest"))


@query("last_n_before", """disc, prices: SELECT trade_id, count(*) AS n, round(avg(close), 6) AS mean FROM (SELECT d.trade_id, p.close, row_number() OVER (PARTITION BY d.trade_id ORDER BY p.date DESC) AS r FROM disc d JOIN prices p ON p.ticker = d.ticker AND p.date < d.filing_date AND p.date >= d.filing_date - 90) WHERE r <= 65 GROUP BY 1""")
def last_n_before(spark, d):
    """The last 65 daily rows before each filing, among those of the last 90 days."""
    x = t.disclosures(spark, d).where("ticker is not null").select("trade_id", "ticker", "filing_date")
    x = x.withColumn("m", F.explode(F.sequence(F.trunc(F.date_sub("filing_date", 90), "MM"), F.trunc(F.date_sub("filing_date", 1), "MM"), F.expr("interval 1 month"))))
    p = t.prices(spark, d).select("ticker", "date", "close", F.trunc("date", "MM").alias("m"))
    j = x.join(p, ["ticker", "m"]).where((F.col("date") < F.col("filing_date")) & (F.col("date") >= F.date_sub("filing_date", 90)))
    return best(j, ["trade_id"], F.desc("date"), n=65).groupBy("trade_id").agg(F.count("*").alias("n"), R6(F.avg("close")).alias("mean"))


@query("pit_consensus_lookup", "disc: SELECT a.trade_id, b.amount AS known_amount FROM disc a ASOF LEFT JOIN (SELECT member, filing_date, arg_max(amount, trade_id) AS amount FROM disc GROUP BY 1, 2) b ON a.member = b.member AND b.filing_date < a.filing_date")
def pit_consensus_lookup(spark, d):
    """The latest fact of the same member that was public strictly before."""
    x = t.disclosures(spark, d)
    facts = x.groupBy("member", F.col("filing_date").alias("known")).agg(F.max_by("amount", "trade_id").alias("known_amount"))
    return asof(x.select("trade_id", "member", "filing_date"), facts, ["member"], "filing_date", "known", ["known_amount"], strict=True).select("trade_id", "known_amount")


@query("interval_validity", """disc: WITH i AS (SELECT member, filing_date AS f, lead(filing_date) OVER (PARTITION BY member ORDER BY filing_date) AS u, ticker FROM (SELECT member, filing_date, max(ticker) AS ticker FROM disc GROUP BY 1, 2))
  SELECT d.trade_id, i.ticker FROM disc d LEFT JOIN i ON i.member = d.member AND i.f <= d.tx_date AND (i.u IS NULL OR d.tx_date < i.u)""")
def interval_validity(spark, d):
    """Mappings valid from one observation to the next; each lookup falls in at most one interval."""
    x = t.disclosures(spark, d)
    m = x.groupBy("member", F.col("filing_date").alias("valid_from")).agg(F.max("ticker").alias("mapped"))
    return asof(x.select("trade_id", "member", "tx_date"), m, ["member"], "tx_date", "valid_from", ["mapped"]).select("trade_id", F.col("mapped").alias("ticker"))


@query("confirm_window", "disc: SELECT a.trade_id, EXISTS (SELECT 1 FROM disc b WHERE b.member = a.member AND b.tx_type = 'SALE' AND b.filing_date BETWEEN a.filing_date - 10 AND a.filing_date + 10) AS confirmed FROM disc a WHERE a.tx_type = 'PURCHASE'")
def confirm_window(spark, d):
    x = t.disclosures(spark, d)
    a, b = x.where("tx_type = 'PURCHASE'").select("trade_id", "member", "filing_date"), x.where("tx_type = 'SALE'").select("member", F.col("filing_date").alias("sold"))
    hit = within(a, b, ["member"], "filing_date", "sold", 10 * 86400, 10 * 86400).select("trade_id", F.lit(True).alias("hit")).distinct()
    return a.join(hit, "trade_id", "left").select("trade_id", F.coalesce("hit", F.lit(False)).alias("confirmed"))


@query("followed_within", "disc: SELECT a.trade_id FROM disc a WHERE a.tx_type = 'PURCHASE' AND EXISTS (SELECT 1 FROM disc b WHERE b.member = a.member AND b.filing_date > a.filing_date AND b.filing_date <= a.filing_date + 30)")
def followed_within(spark, d):
    x = t.disclosures(spark, d)
    w = W.partitionBy("member").orderBy(F.unix_date("filing_date")).rangeBetween(1, 30)
    return x.withColumn("n", F.count("*").over(w)).where("n > 0 and tx_type = 'PURCHASE'").select("trade_id")


@query("count_prior_90d", "disc: SELECT trade_id, count(*) OVER (PARTITION BY member ORDER BY filing_date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM disc")
def count_prior_90d(spark, d):
    w = W.partitionBy("member").orderBy(F.unix_date("filing_date")).rangeBetween(-90, 0)
    return t.disclosures(spark, d).select("trade_id", F.count("*").over(w).alias("n"))


@query("cluster_count_30d", "disc: SELECT a.trade_id, count(DISTINCT b.member) AS others FROM disc a LEFT JOIN disc b ON a.ticker = b.ticker AND b.member <> a.member AND b.filing_date >= a.filing_date - 30 AND b.filing_date < a.filing_date GROUP BY 1")
def cluster_count_30d(spark, d):
    """Other members on the same ticker in the 30 days before."""
    x = t.disclosures(spark, d)
    facts = x.groupBy("ticker", F.col("filing_date").alias("known"), F.col("member").alias("other")).agg(F.count("*").alias("c"))
    pairs = within(x.select("trade_id", "ticker", "member", "filing_date"), facts, ["ticker"], "filing_date", "known", 30 * 86400, -86400).where("other <> member")
    got = pairs.select("trade_id", "other").distinct().groupBy("trade_id").agg(F.count("*").alias("others"))
    return x.select("trade_id").join(got, "trade_id", "left").select("trade_id", F.coalesce("others", F.lit(0)).cast("long").alias("others"))


@query("repeat_flag", "disc: SELECT trade_id, coalesce(filing_date - lag(filing_date) OVER (PARTITION BY member, ticker ORDER BY filing_date, trade_id) <= 365, false) AS repeat FROM disc")
def repeat_flag(spark, d):
    before = F.lag("filing_date").over(W.partitionBy("member", "ticker").orderBy("filing_date", "trade_id"))
    return t.disclosures(spark, d).select("trade_id", F.coalesce(F.datediff("filing_date", before) <= 365, F.lit(False)).alias("repeat"))


FWD = """disc, sessions: WITH e AS (SELECT d.*, s.idx AS i FROM disc d ASOF LEFT JOIN sessions s ON d.filing_date {op} s.date), px AS (SELECT ticker, idx, close FROM prices JOIN sessions USING (date))
  SELECT e.trade_id, {cols} FROM e LEFT JOIN px a ON a.ticker = e.ticker AND a.idx = i LEFT JOIN px b ON b.ticker = e.ticker AND b.idx = i + {h}"""


@query("forward_return_h", FWD.format(op="<=", h=21, cols="round(b.close / a.close - 1, 6) AS fwd"))
def forward_return_h(spark, d):
    return panel.forward_return(t.prices(spark, d), t.sessions(spark, d), t.disclosures(spark, d), "filing_date", 21).select("trade_id", R6("fwd").alias("fwd"))


@query("next_session_strict", FWD.format(op="<", h=5, cols="round(b.close / a.close - 1, 6) AS fwd"))
def next_session_strict(spark, d):
    return panel.forward_return(t.prices(spark, d), t.sessions(spark, d), t.disclosures(spark, d), "filing_date", 5, strict=True).select("trade_id", R6("fwd").alias("fwd"))


@query("abnormal_return", """disc, sessions: WITH e AS (SELECT d.*, s.idx AS i FROM disc d ASOF LEFT JOIN sessions s ON d.filing_date <= s.date), px AS (SELECT ticker, idx, close FROM prices JOIN sessions USING (date)), mk AS (SELECT idx, avg(close) AS close FROM px GROUP BY 1)
  SELECT tx_type, count(*) AS n, round(avg(b.close / a.close - n.close / m.close), 6) AS mean_ar, round(avg(CASE WHEN b.close / a.close > n.close / m.close THEN 1.0 ELSE 0.0 END), 6) AS beats
  FROM e JOIN px a ON a.ticker = e.ticker AND a.idx = i JOIN px b ON b.ticker = e.ticker AND b.idx = i + 21 JOIN mk m ON m.idx = i JOIN mk n ON n.idx = i + 21 GROUP BY 1""")
def abnormal_return(spark, d):
    p, s = t.prices(spark, d), t.sessions(spark, d)
    e = panel.forward_return(p, s, t.disclosures(spark, d), "filing_date", 21)
    mk = p.join(s, "date").groupBy("idx").agg(F.avg("close").alias("m"))
    m = mk.select(F.col("idx").alias("entry_idx"), F.col("m").alias("m0")).join(mk.select((F.col("idx") - 21).alias("entry_idx"), F.col("m").alias("m1")), "entry_idx")
    j = e.join(m, "entry_idx").where("fwd is not null").withColumn("mk", F.col("m1") / F.col("m0") - 1)
    return j.groupBy("tx_type").agg(F.count("*").alias("n"), R6(F.avg(F.col("fwd") - F.col("mk"))).alias("mean_ar"), R6(F.avg(F.when(F.col("fwd") > F.col("mk"), 1.0).otherwise(0.0))).alias("beats"))


@query("alpha_decay", """disc, sessions: WITH e AS (SELECT d.ticker, s.idx + delay AS i, delay FROM (SELECT * FROM disc WHERE tx_type = 'PURCHASE') d ASOF JOIN sessions s ON d.filing_date <= s.date CROSS JOIN (VALUES (0), (1), (5), (10)) v(delay)),
  px AS (SELECT ticker, idx, close FROM prices JOIN sessions USING (date)), fw AS (SELECT a.ticker, a.idx AS i, b.close / a.close - 1 AS fwd FROM px a JOIN px b ON b.ticker = a.ticker AND b.idx = a.idx + 21)
  SELECT CAST(delay AS INT) AS delay, count(*) AS n, round(avg(fwd) * 10000, 3) AS mean_bps FROM e JOIN fw ON fw.ticker = e.ticker AND fw.i = e.i GROUP BY 1""")
def alpha_decay(spark, d):
    p, s = t.prices(spark, d), t.sessions(spark, d)
    e = t.disclosures(spark, d).where("tx_type = 'PURCHASE'").join(panel.next_session(s).select(F.col("day").alias("filing_date"), "idx"), "filing_date")
    e = e.withColumn("delay", F.explode(F.array(*[F.lit(x) for x in (0, 1, 5, 10)]))).withColumn("i", F.col("idx") + F.col("delay"))
    px = p.join(s, "date").select("ticker", F.col("idx").alias("i"), "close")
    fwd = px.withColumn("i", F.col("i") - 21).withColumnRenamed("close", "later")
    return e.drop("idx").join(px, ["ticker", "i"]).join(fwd, ["ticker", "i"]).groupBy("delay").agg(F.count("*").alias("n"), F.round(F.avg(F.col("later") / F.col("close") - 1) * 10000, 3).alias("mean_bps"))


@query("rolling_beta", """rets: WITH m AS (SELECT date, avg(ret) AS mkt FROM rets GROUP BY 1), j AS (SELECT ticker, date, ret, mkt FROM rets JOIN m USING (date))
  SELECT ticker, date, round(CASE WHEN count(ret + mkt) OVER w = 60 AND var_samp(mkt) OVER w > 0 THEN covar_samp(ret, mkt) OVER w / var_samp(mkt) OVER w END, 5) AS beta,
  round(CASE WHEN count(ret + mkt) OVER w = 60 AND var_pop(mkt) OVER w > 0 THEN covar_samp(ret, mkt) OVER w / var_pop(mkt) OVER w END, 5) AS mixed FROM j
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def rolling_beta(spark, d):
    r = t.returns(t.prices(spark, d)).withColumn("mkt", F.avg("ret").over(W.partitionBy("date")))
    return r.select("ticker", "date", F.round(panel.rolling_beta("ret", "mkt", "ticker", "date", 60), 5).alias("beta"), F.round(panel.rolling_beta("ret", "mkt", "ticker", "date", 60, mixed=True), 5).alias("mixed"))


@query("two_factor_residual", """brets: WITH j AS (SELECT b.ticker, b.ts, b.ret AS y, m.ret AS m, s.ret - m.ret AS s FROM brets b JOIN brets m ON m.ts = b.ts AND m.ticker = 'view' JOIN brets s ON s.ts = b.ts AND s.ticker = 'click' WHERE b.ticker NOT IN ('view', 'click')),
  a AS (SELECT *, count(y + m + s) OVER w AS n, avg(m * m) OVER w - avg(m) OVER w * avg(m) OVER w AS mm, avg(s * s) OVER w - avg(s) OVER w * avg(s) OVER w AS ss, avg(m * s) OVER w - avg(m) OVER w * avg(s) OVER w AS ms,
   avg(m * y) OVER w - avg(m) OVER w * avg(y) OVER w AS my, avg(s * y) OVER w - avg(s) OVER w * avg(y) OVER w AS sy FROM j WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, (my * ss - sy * ms) / (mm * ss - ms * ms) AS bm, (sy * mm - my * ms) / (mm * ss - ms * ms) AS bs FROM a WHERE n = 30 AND abs(mm * ss - ms * ms) > 1e-14)
  SELECT ticker, epoch(ts)::BIGINT AS at, round(y - bm * m - bs * s, 4) AS resid FROM b""")
def two_factor_residual(spark, d):
    r = t.returns(t.bars(spark, d), at="ts").select("ticker", "ts", "ret")
    at, has = W.partitionBy("ts"), lambda x: F.count_if(F.col("ticker") == x).over(W.partitionBy("ts")) > 0
    factor = lambda x: F.max(F.when(F.col("ticker") == x, F.col("ret"))).over(at)
    j = r.withColumns({"m": factor("view"), "s": factor("click") - factor("view"), "both": has("view") & has("click")}).where("both and ticker not in ('view', 'click')")
    _, _, resid = panel.two_factor_residual("ret", "m", "s", "ticker", "ts", 30)
    return j.select("ticker", secs("ts").alias("at"), F.round(resid, 4).alias("resid")).where("resid is not null")


@query("tod_relative_volume", """bars: SELECT ticker, epoch(ts)::BIGINT AS at, round(CASE WHEN count(volume) OVER w >= 5 AND median(volume) OVER w > 0 THEN volume / median(volume) OVER w END, 5) AS rel FROM bars
  WINDOW w AS (PARTITION BY ticker, hour(ts) ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def tod_relative_volume(spark, d):
    w = panel.trailing(["ticker", "slot"], "ts", 10)
    m = panel.rolling_median("volume", w, 5)
    return t.bars(spark, d).withColumn("slot", F.hour("ts")).withColumn("m", m).select("ticker", secs("ts").alias("at"), F.round(F.when(F.col("m") > 0, F.col("volume") / F.col("m")), 5).alias("rel"))


@query("atr_ma_regime", """prices: WITH p AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM prices), q AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p),
  r AS (SELECT ticker, date, close, count(tr) OVER a AS n, avg(tr) OVER a AS atr, count(close) OVER b AS nb, avg(close) OVER b AS ma50 FROM q WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
  s AS (SELECT *, CASE WHEN nb = 50 THEN close < ma50 END AS below FROM r)
  SELECT ticker, date, round(CASE WHEN n >= 7 THEN atr END, 5) AS atr, coalesce(below AND lag(below) OVER (PARTITION BY ticker ORDER BY date), false) AS two_below FROM s""")
def atr_ma_regime(spark, d):
    o = W.partitionBy("ticker").orderBy("date")
    p = t.prices(spark, d).withColumn("pc", F.lag("close").over(o))
    p = p.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))))
    a, b = o.rowsBetween(-13, 0), o.rowsBetween(-49, 0)
    p = p.withColumns({"atr": panel.full(F.avg("tr").over(a), F.col("tr"), a, 7), "below": panel.full(F.col("close") < F.avg("close").over(b), F.col("close"), b, 50)})
    return p.select("ticker", "date", F.round("atr", 5).alias("atr"), F.coalesce(F.col("below") & F.lag("below").over(o), F.lit(False)).alias("two_below"))


@query("trailing_mom_vol", """rets: SELECT ticker, date, round(close / lag(close, 20) OVER o - 1, 6) AS mom, round(CASE WHEN count(ret) OVER w > 5 THEN stddev_samp(ret) OVER w END, 6) AS vol, round(CASE WHEN count(close) OVER v = 63 THEN median(close * volume) OVER v END, 3) AS adv FROM rets
  WINDOW o AS (PARTITION BY ticker ORDER BY date), w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def trailing_mom_vol(spark, d):
    o = W.partitionBy("ticker").orderBy("date")
    r = t.returns(t.prices(spark, d)).withColumn("dv", F.col("close") * F.col("volume"))
    w, v = panel.trailing("ticker", "date", 20), o.rowsBetween(-62, 0)
    return r.select("ticker", "date", R6(F.try_divide("close", F.lag("close", 20).over(o)) - 1).alias("mom"), R6(panel.full(F.stddev_samp("ret").over(w), F.col("ret"), w, 6)).alias("vol"), F.round(panel.rolling_median("dv", v, 63), 3).alias("adv"))


@query("expanding_median", "disc: SELECT trade_id, round(median(amount) OVER (PARTITION BY member ORDER BY filing_date, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS prior FROM disc")
def expanding_median(spark, d):
    w = W.partitionBy("member").orderBy("filing_date", "trade_id").rowsBetween(W.unboundedPreceding, -1)
    return t.disclosures(spark, d).select("trade_id", F.round(F.percentile("amount", 0.5).over(w), 4).alias("prior"))


@query("xs_demean_rank", """rets: SELECT ticker, date, round(ret - avg(ret) OVER (PARTITION BY date), 6) AS demeaned, (rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS pct FROM rets WHERE ret IS NOT NULL""")
def xs_demean_rank(spark, d):
    r = t.returns(t.prices(spark, d)).where("ret is not null")
    return r.select("ticker", "date", R6(panel.demean("ret", "date")).alias("demeaned"), (panel.average_rank("ret", "date") / F.count("*").over(W.partitionBy("date"))).alias("pct"))


@query("ls_weights_backtest", """rets: WITH s AS (SELECT ticker, date, ret, rank() OVER (PARTITION BY date ORDER BY ret) AS r, count(*) OVER (PARTITION BY date) AS n FROM rets WHERE ret IS NOT NULL), w AS (SELECT *, CASE WHEN n < 5 THEN 0.0 WHEN r <= 2 THEN 0.5 WHEN r > n - 2 THEN -0.5 ELSE 0.0 END AS w FROM s),
  x AS (SELECT *, lag(w) OVER (PARTITION BY ticker ORDER BY date) AS held FROM w) SELECT date, round(sum(held * ret), 6) AS pnl, round(sum(abs(w - coalesce(held, 0))), 6) AS turnover FROM x WHERE held IS NOT NULL GROUP BY 1""")
def ls_weights_backtest(spark, d):
    """Yesterday's losers long, winners short, held for the next day."""
    x = t.returns(t.prices(spark, d)).where("ret is not null")
    by = W.partitionBy("date")
    x = x.withColumns({"r": F.rank().over(by.orderBy("ret")), "n": F.count("*").over(by)})
    x = x.withColumn("w", F.when(F.col("n") < 5, 0.0).when(F.col("r") <= 2, 0.5).when(F.col("r") > F.col("n") - 2, -0.5).otherwise(0.0))
    x = x.withColumn("held", F.lag("w").over(W.partitionBy("ticker").orderBy("date"))).where("held is not null")
    return x.groupBy("date").agg(R6(F.sum(F.col("held") * F.col("ret"))).alias("pnl"), R6(F.sum(F.abs(F.col("w") - F.col("held")))).alias("turnover"))


@query("tsmom", """rets: WITH s AS (SELECT *, (sign(close / lag(close, 21) OVER o - 1) + sign(close / lag(close, 63) OVER o - 1)) / 2.0::DOUBLE AS sig, stddev_samp(ret) OVER w * sqrt(252) AS vol, count(ret) OVER w AS n FROM rets WINDOW o AS (PARTITION BY ticker ORDER BY date), w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
  m AS (SELECT *, CASE WHEN date = max(date) OVER (PARTITION BY ticker, date_trunc('month', date)) AND n = 60 AND vol > 0 THEN sig * least(1.0, 0.10 / vol) END AS wm FROM s),
  f AS (SELECT *, last_value(wm IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM m)
  SELECT date, round(sum(w * ret) / count(w), 7) AS net FROM f WHERE w IS NOT NULL GROUP BY 1""")
def tsmom(spark, d):
    """Month-end momentum weights, scaled to a volatility target, carried through the next month."""
    o = W.partitionBy("ticker").orderBy("date")
    w = o.rowsBetween(-59, 0)
    r = t.returns(t.prices(spark, d))
    sign = lambda k: F.signum(F.try_divide("close", F.lag("close", k).over(o)) - 1)
    r = r.withColumns({"sig": (sign(21) + sign(63)) / 2, "vol": panel.full(F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0)), F.col("ret"), w, 60)})
    last = F.col("date") == F.max("date").over(W.partitionBy("ticker", F.trunc("date", "MM")))
    r = r.withColumn("wm", F.when(last & (F.col("vol") > 0), F.col("sig") * F.least(F.lit(1.0), 0.10 / F.col("vol"))))
    r = r.withColumn("w", F.last("wm", ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, -1))).where("w is not null")
    return r.groupBy("date").agg(F.round(F.sum(F.col("w") * F.col("ret")) / F.count("w"), 7).alias("net"))


@query("ofi_bars", """quotes: WITH s AS (SELECT *, CASE WHEN k % 2 = 0 THEN value ELSE 0 END AS buy, CASE WHEN k % 2 = 1 THEN value ELSE 0 END AS sell FROM quotes) SELECT ticker, epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT AS at, count(*) AS trades, round(sum(buy), 4) AS buy, round(sum(sell), 4) AS sell,
  round((sum(buy) - sum(sell)) / nullif(sum(buy) + sum(sell), 0), 6) AS ofi, round(sum(value * (k + 1)) / sum(k + 1), 3) AS vwap, round(arg_max(value, ts), 6) AS close FROM s GROUP BY 1, 2""")
def ofi_bars(spark, d):
    return portfolio.flow_bars(t.quotes(spark, d), "30 minutes").select("ticker", secs("start").alias("at"), "trades", F.round("buy", 4).alias("buy"), F.round("sell", 4).alias("sell"), R6("ofi").alias("ofi"), F.round("vwap", 3).alias("vwap"), R6("close").alias("close"))


@query("ofi_features", """bars: WITH r AS (SELECT *, volume - lag(volume) OVER o AS dv FROM bars WINDOW o AS (PARTITION BY ticker ORDER BY ts)) SELECT ticker, epoch(ts)::BIGINT AS at, round(dv, 5) AS dv, round(CASE WHEN count(volume) OVER w = 24 AND stddev_pop(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w END, 5) AS z,
  round(sin(2 * pi() * hour(ts) / 24), 6) AS tod_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS tod_cos FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def ofi_features(spark, d):
    b = t.bars(spark, d).withColumn("dv", F.col("volume") - F.lag("volume").over(W.partitionBy("ticker").orderBy("ts")))
    a = 2 * 3.141592653589793 * F.hour("ts") / 24
    return b.select("ticker", secs("ts").alias("at"), F.round("dv", 5).alias("dv"), F.round(panel.past_z("volume", "ticker", "ts", 24), 5).alias("z"), R6(F.sin(a)).alias("tod_sin"), R6(F.cos(a)).alias("tod_cos"))


@query("drawdown_equity", """rets: WITH e AS (SELECT ticker, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER o) AS eq FROM rets WINDOW o AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, round(eq, 5) AS equity, round(eq / max(eq) OVER (PARTITION BY ticker ORDER BY date) - 1, 5) AS drawdown FROM e""")
def drawdown_equity(spark, d):
    o = W.partitionBy("ticker").orderBy("date")
    r = t.returns(t.prices(spark, d)).withColumn("eq", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(o)))
    return r.select("ticker", "date", F.round("eq", 5).alias("equity"), F.round(F.col("eq") / F.max("eq").over(o) - 1, 5).alias("drawdown"))


@query("peer_mean_ex_self", "rets: SELECT ticker, date, round((sum(ret) OVER w - ret) / nullif(count(ret) OVER w - 1, 0), 6) AS peers FROM rets WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY date)")
def peer_mean_ex_self(spark, d):
    w = W.partitionBy("date")
    r = t.returns(t.prices(spark, d)).where("ret is not null")
    return r.select("ticker", "date", R6((F.sum("ret").over(w) - F.col("ret")) / F.nullif(F.count("ret").over(w) - 1, F.lit(0))).alias("peers"))


@query("forward_hedged_outcome", """bars: WITH f AS (SELECT ticker, ts, lead(close, 3) OVER o / nullif(lead(open, 1) OVER o, 0) - 1 AS fwd, CAST(lead(ts, 3) OVER o AS DATE) = CAST(ts AS DATE) AS same FROM bars WINDOW o AS (PARTITION BY ticker ORDER BY ts)), v AS (SELECT * FROM f WHERE ticker = 'view')
  SELECT f.ticker, epoch(f.ts)::BIGINT AS at, round(f.fwd - v.fwd, 6) AS hedged FROM f JOIN v USING (ts) WHERE f.ticker <> 'view' AND f.same AND v.same AND f.fwd IS NOT NULL AND v.fwd IS NOT NULL""")
def forward_hedged_outcome(spark, d):
    o = W.partitionBy("ticker").orderBy("ts")
    b = t.bars(spark, d).withColumns({"fwd": F.try_divide(F.lead("close", 3).over(o), F.lead("open", 1).over(o)) - 1, "same": F.to_date(F.lead("ts", 3).over(o)) == F.to_date("ts")})
    b = b.where("same and fwd is not null").select("ticker", "ts", "fwd")
    v = b.where("ticker = 'view'").select("ts", F.col("fwd").alias("hedge"))
    return b.where("ticker <> 'view'").join(v, "ts").select("ticker", secs("ts").alias("at"), R6(F.col("fwd") - F.col("hedge")).alias("hedged"))


@query("persistence_flow", """brets: WITH s AS (SELECT *, sign(ret) AS g, lag(CAST(ts AS DATE), 3) OVER (PARTITION BY ticker ORDER BY ts) AS d3 FROM brets), f AS (SELECT *, sum(g) OVER w AS sg, sum(g * volume) OVER w AS flow FROM s WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  SELECT ticker, epoch(ts)::BIGINT AS at, round(flow, 4) AS flow, coalesce(abs(sg) = 4 AND d3 = CAST(ts AS DATE), false) AS persistent FROM f WHERE ret IS NOT NULL""")
def persistence_flow(spark, d):
    o = W.partitionBy("ticker").orderBy("ts")
    r = t.returns(t.bars(spark, d), at="ts").withColumns({"g": F.signum("ret"), "d3": F.lag(F.to_date("ts"), 3).over(o)})
    w = o.rowsBetween(-3, 0)
    r = r.withColumns({"sg": F.sum("g").over(w), "flow": F.sum(F.col("g") * F.col("volume")).over(w)}).where("ret is not null")
    return r.select("ticker", secs("ts").alias("at"), F.round("flow", 4).alias("flow"), F.coalesce((F.abs("sg") == 4) & (F.col("d3") == F.to_date("ts")), F.lit(False)).alias("persistent"))


@query("opening_aggregate", "bars: SELECT ticker, CAST(ts AS DATE) AS date, round(arg_min(open, ts), 6) AS open, round(arg_max(close, ts), 6) AS close, round(sum(volume), 4) AS volume, count(*) AS n FROM bars WHERE hour(ts) BETWEEN 9 AND 11 GROUP BY 1, 2 HAVING count(*) >= 2")
def opening_aggregate(spark, d):
    b = t.bars(spark, d).where(F.hour("ts").between(9, 11))
    return b.groupBy("ticker", F.to_date("ts").alias("date")).agg(R6(F.min_by("open", "ts")).alias("open"), R6(F.max_by("close", "ts")).alias("close"), F.round(F.sum("volume"), 4).alias("volume"), F.count("*").alias("n")).where("n >= 2")


@query("densified_panel", "bars: SELECT t.ticker, epoch(s.ts)::BIGINT AS at, b.trades, b.ts IS NULL AS missing FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT ts FROM bars) s LEFT JOIN bars b ON b.ticker = t.ticker AND b.ts = s.ts")
def densified_panel(spark, d):
    return panel.densify(t.bars(spark, d).select("ticker", "ts", "trades"), "ticker", "ts").select("ticker", secs("ts").alias("at"), "trades", F.col("trades").isNull().alias("missing"))


@query("last_price_carry", "bars: SELECT t.ticker, epoch(s.ts)::BIGINT AS at, round(last_value(b.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY s.ts), 6) AS px FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT ts FROM bars) s LEFT JOIN bars b ON b.ticker = t.ticker AND b.ts = s.ts")
def last_price_carry(spark, d):
    w = W.partitionBy("ticker").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return panel.densify(t.bars(spark, d).select("ticker", "ts", "close"), "ticker", "ts").select("ticker", secs("ts").alias("at"), R6(F.last("close", ignorenulls=True).over(w)).alias("px"))


@query("reversal_signal_skip", "rets: SELECT ticker, date, round(-sum(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS reversal, round(sum(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 25 PRECEDING AND 6 PRECEDING), 6) AS momentum FROM rets")
def reversal_signal_skip(spark, d):
    o = W.partitionBy("ticker").orderBy("date")
    return t.returns(t.prices(spark, d)).select("ticker", "date", R6(-F.sum("ret").over(o.rowsBetween(-5, -1))).alias("reversal"), R6(F.sum("ret").over(o.rowsBetween(-25, -6))).alias("momentum"))


@query("dollar_neutral_weights", "rets: WITH s AS (SELECT ticker, date, avg(ret) OVER (PARTITION BY date) - ret AS sig FROM rets WHERE ret IS NOT NULL), c AS (SELECT *, greatest(-0.3, least(0.3, sig / nullif(sum(abs(sig)) OVER (PARTITION BY date), 0))) AS w FROM s) SELECT ticker, date, round(w / nullif(sum(abs(w)) OVER (PARTITION BY date), 0), 6) AS w FROM c")
def dollar_neutral_weights(spark, d):
    by = W.partitionBy("date")
    r = t.returns(t.prices(spark, d)).where("ret is not null").withColumn("sig", -panel.demean("ret", "date"))
    scale = lambda c: F.col(c) / F.nullif(F.sum(F.abs(c)).over(by), F.lit(0.0))
    r = r.withColumn("w", F.greatest(F.lit(-0.3), F.least(F.lit(0.3), scale("sig"))))
    return r.select("ticker", "date", R6(scale("w")).alias("w"))


@query("third_friday_flag", "prices: SELECT date, CAST(date_trunc('month', date) AS DATE) + CAST((12 - isodow(date_trunc('month', date))) % 7 + 14 AS INT) AS third_friday, abs(date - (CAST(date_trunc('month', date) AS DATE) + CAST((12 - isodow(date_trunc('month', date))) % 7 + 14 AS INT))) <= 4 AS near FROM (SELECT DISTINCT date FROM prices)")
def third_friday_flag(spark, d):
    x = t.prices(spark, d).select("date").distinct().withColumn("third_friday", market.third_friday(F.col("date")))
    return x.select("date", "third_friday", (F.abs(F.datediff("date", "third_friday")) <= 4).alias("near"))


@query("shrunk_beta", "rets: WITH m AS (SELECT date, avg(ret) AS mkt FROM rets GROUP BY 1), b AS (SELECT ticker, regr_slope(ret, mkt) AS raw, count(ret) AS n FROM rets JOIN m USING (date) WHERE ret IS NOT NULL GROUP BY 1) SELECT ticker, round(raw, 5) AS raw, round(greatest(0.0, least(2.0, n / (n + 20.0::DOUBLE) * raw + 1 - n / (n + 20.0::DOUBLE))), 5) AS beta FROM b")
def shrunk_beta(spark, d):
    r = t.returns(t.prices(spark, d))
    r = r.join(r.groupBy("date").agg(F.avg("ret").alias("mkt")), "date").where("ret is not null")
    b = r.groupBy("ticker").agg(F.regr_slope("ret", "mkt").alias("raw"), F.count("ret").alias("n"))
    return b.select("ticker", F.round("raw", 5).alias("raw"), F.round(market.shrunk_beta(F.col("raw"), F.col("n")), 5).alias("beta"))
