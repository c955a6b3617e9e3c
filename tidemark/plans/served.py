"""Served queries and ingest-shaped operators: members, tickers, summaries, resolution, extraction and model runs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators.tables import best
from tidemark.plans import tables as t
from tidemark.registry import query
from tidemark.session import load


@query("serve_health", "SELECT count(*) AS trades, max(o_orderkey) AS last FROM orders")
def serve_health(spark, d):
    return load(spark, d, "orders").agg(F.count("*").alias("trades"), F.max("o_orderkey").alias("last"))


@query("serve_member", "disc, members: SELECT trade_id, name, sector, tx_type, amount FROM disc JOIN members USING (member) WHERE member = 7 ORDER BY filing_date DESC, trade_id LIMIT 100")
def serve_member(spark, d):
    x = t.disclosures(spark, d).where("member = 7").join(t.members(spark, d), "member")
    return x.orderBy(F.desc("filing_date"), "trade_id").limit(100).select("trade_id", "name", "sector", "tx_type", "amount")


@query("serve_ticker", "prices: SELECT date, round(close, 6) AS close, volume FROM prices WHERE ticker = 'PROMO' ORDER BY date DESC LIMIT 250")
def serve_ticker(spark, d):
    return t.prices(spark, d).where("ticker = 'PROMO'").orderBy(F.desc("date")).limit(250).select("date", F.round("close", 6).alias("close"), "volume")


@query("serve_portfolio_today", "prices: WITH l AS (SELECT ticker, max(date) AS date, arg_max(close, date) AS px, arg_max(volume, date) AS v FROM prices GROUP BY 1) SELECT ticker, date, round(px * v / sum(px * v) OVER (), 6) AS weight FROM l")
def serve_portfolio_today(spark, d):
    p = t.prices(spark, d).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("px"), F.max_by("volume", "date").alias("v"))
    return p.select("ticker", "date", F.round(F.col("px") * F.col("v") / F.sum(F.col("px") * F.col("v")).over(W.partitionBy()), 6).alias("weight"))


@query("serve_events_summary", "SELECT event_type AS layer, count(*) AS n, count(DISTINCT user_id) AS users, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1")
def serve_events_summary(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))


@query("forward_readiness", "disc: SELECT count(DISTINCT filing_date) AS days, count(*) AS decisions, count(DISTINCT filing_date) >= 60 AND count(*) >= 100 AS ready FROM disc WHERE tx_type = 'PURCHASE'")
def forward_readiness(spark, d):
    x = t.disclosures(spark, d).where("tx_type = 'PURCHASE'").agg(F.count_distinct("filing_date").alias("days"), F.count("*").alias("decisions"))
    return x.withColumn("ready", (F.col("days") >= 60) & (F.col("decisions") >= 100))


@query("slice_report", """disc: SELECT slice, count(*) AS n, round(avg(amount), 3) AS mean FROM disc, (VALUES ('all'), ('large'), ('fast'), ('purchase')) v(slice) WHERE slice = 'all' OR (slice = 'large' AND amount >= 250000) OR (slice = 'fast' AND filing_date - tx_date <= 10) OR (slice = 'purchase' AND tx_type = 'PURCHASE') GROUP BY 1""")
def slice_report(spark, d):
    flag = lambda c, n: F.when(c, F.lit(n))
    x = t.disclosures(spark, d)
    names = F.array_compact(F.array(F.lit("all"), flag(F.col("amount") >= 250000, "large"), flag(F.datediff("filing_date", "tx_date") <= 10, "fast"), flag(F.col("tx_type") == "PURCHASE", "purchase")))
    return x.withColumn("slice", F.explode(names)).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 3).alias("mean"))


@query("entry_gates", """disc: SELECT trade_id, array_to_string(list_filter([CASE WHEN amount < 100000 THEN 'SMALL' END, CASE WHEN filing_date - tx_date > 30 THEN 'STALE' END, CASE WHEN ticker IS NULL THEN 'NO_TICKER' END, CASE WHEN tx_type <> 'PURCHASE' THEN 'NOT_PURCHASE' END], lambda x: x IS NOT NULL), ',') AS failed FROM disc""")
def entry_gates(spark, d):
    """Every failed gate by name; an empty list is an entry."""
    gate = lambda c, n: F.when(c, F.lit(n))
    failed = F.array_compact(F.array(gate(F.col("amount") < 100000, "SMALL"), gate(F.datediff("filing_date", "tx_date") > 30, "STALE"), gate(F.col("ticker").isNull(), "NO_TICKER"), gate(F.col("tx_type") != "PURCHASE", "NOT_PURCHASE")))
    return t.disclosures(spark, d).select("trade_id", F.array_join(failed, ",").alias("failed"))


@query("recipient_resolution", r"""WITH s AS (SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM supplier), c AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM customer),
  x AS (SELECT split_part(k, ' ', 2) AS tail, min(c_custkey) AS id FROM c GROUP BY 1) SELECT s_suppkey, coalesce(c.c_custkey, x.id) AS id, CASE WHEN c.c_custkey IS NOT NULL THEN 'EXACT' WHEN x.id IS NOT NULL THEN 'TAIL' ELSE 'NONE' END AS how FROM s LEFT JOIN c ON c.k = s.k LEFT JOIN x ON x.tail = split_part(s.k, ' ', 2)""")
def recipient_resolution(spark, d):
    """Exact normalised name, else the last part of the name, first id wins."""
    s = load(spark, d, "supplier").select("s_suppkey", text.name_key(F.col("s_name")).alias("k")).withColumn("tail", F.element_at(F.split("k", " "), -1))
    c = load(spark, d, "customer").select("c_custkey", text.name_key(F.col("c_name")).alias("k"))
    tail = c.groupBy(F.element_at(F.split("k", " "), -1).alias("tail")).agg(F.min("c_custkey").alias("t"))
    j = s.join(c, "k", "left").join(tail, "tail", "left")
    return j.select("s_suppkey", F.coalesce("c_custkey", "t").alias("id"), F.when(F.col("c_custkey").isNotNull(), "EXACT").when(F.col("t").isNotNull(), "TAIL").otherwise("NONE").alias("how"))


@query("keyword_sectors", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_type), 'eco') THEN 'energy' END, CASE WHEN contains(lower(p_type), 'pro') THEN 'retail' END, CASE WHEN p_size > 25 THEN 'industrial' END], lambda x: x IS NOT NULL), ',') AS sectors FROM part")
def keyword_sectors(spark, d):
    hit = lambda c, n: F.when(c, F.lit(n))
    low = F.lower("p_type")
    return load(spark, d, "part").select("p_partkey", F.array_join(F.array_compact(F.array(hit(low.contains("eco"), "energy"), hit(low.contains("pro"), "retail"), hit(F.col("p_size") > 25, "industrial"))), ",").alias("sectors"))


@query("action_classifier", r"""SELECT conv_id, turn, role, CASE WHEN regexp_matches(lower(text), '\b(withdraw|remove)') THEN 'WITHDRAWN' WHEN regexp_matches(lower(text), '\b(reaffirm|keep|same)') THEN 'REAFFIRMED' WHEN regexp_matches(lower(text), '\b(raise|more|up)\b') THEN 'RAISED' WHEN regexp_matches(lower(text), '\b(lower|less|down)\b') THEN 'LOWERED' ELSE 'INITIATED' END AS action FROM conversations""")
def action_classifier(spark, d):
    low = F.lower("text")
    rule = F
    for pattern, label in ((r"\b(withdraw|remove)", "WITHDRAWN"), (r"\b(reaffirm|keep|same)", "REAFFIRMED"), (r"\b(raise|more|up)\b", "RAISED"), (r"\b(lower|less|down)\b", "LOWERED")):
        rule = rule.when(F.regexp_like(low, F.lit(pattern)), label)
    return load(spark, d, "conversations").select("conv_id", "turn", "role", rule.otherwise("INITIATED").alias("action"))


@query("canonical_trade_row", "disc: SELECT trade_id, sha1(concat_ws('|', CAST(member AS VARCHAR), ticker, CAST(tx_date AS VARCHAR))) AS row_hash, CAST(filing_date - tx_date AS INT) AS lag FROM disc WHERE filing_date >= tx_date AND year(tx_date) >= 1992")
def canonical_trade_row(spark, d):
    x = t.disclosures(spark, d).where("filing_date >= tx_date and year(tx_date) >= 1992")
    return x.select("trade_id", F.sha1(F.concat_ws("|", F.col("member").cast("string"), "ticker", F.col("tx_date").cast("string"))).alias("row_hash"), F.datediff("filing_date", "tx_date").alias("lag"))


@query("most_traded_universe", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 40")
def most_traded_universe(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(40)


@query("share_class_choice", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def share_class_choice(spark, d):
    return best(load(spark, d, "part"), ["p_brand"], F.desc("p_retailprice"), "p_partkey").select("p_brand", "p_partkey")


@query("magnitude_score", "disc: SELECT trade_id, round(greatest(0.0, least(1.0, log10(greatest(amount, 1)) / 6)), 6) AS magnitude, round(greatest(0.0, least(1.0, 1 - (filing_date - tx_date) / 45.0::DOUBLE)), 6) AS novelty FROM disc")
def magnitude_score(spark, d):
    unit = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    return t.disclosures(spark, d).select("trade_id", unit(F.log10(F.greatest("amount", F.lit(1))) / 6).alias("magnitude"), unit(1 - F.datediff("filing_date", "tx_date") / 45.0).alias("novelty"))


@query("cost_sweep", "rets: WITH w AS (SELECT date, avg(ret) AS g, count(*) AS n FROM rets WHERE ret IS NOT NULL GROUP BY 1) SELECT bps, round(avg(g - bps / 10000.0::DOUBLE) * 10000, 4) AS net_bps FROM w, (VALUES (0), (5), (10), (20)) v(bps) GROUP BY 1")
def cost_sweep(spark, d):
    g = t.returns(t.prices(spark, d)).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("g"))
    x = g.withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 5, 10, 20)])))
    return x.groupBy("bps").agg(F.round(F.avg(F.col("g") - F.col("bps") / 10000.0) * 10000, 4).alias("net_bps"))


@query("elastic_net_forward")
def elastic_net_forward(spark, d):
    """Expanding walk-forward elastic net of next-day returns on momentum and volatility; predictions of the test part only."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    o = W.partitionBy("ticker").orderBy("date")
    r = t.returns(t.prices(spark, d))
    r = r.withColumns({"mom": F.sum("ret").over(o.rowsBetween(-20, 0)), "vol": F.stddev_samp("ret").over(o.rowsBetween(-20, 0)), "y": F.lead("ret").over(o)}).dropna(subset=["mom", "vol", "y"])
    x = VectorAssembler(inputCols=["mom", "vol"], outputCol="x").transform(r)
    model = LinearRegression(featuresCol="x", labelCol="y", regParam=1e-4, elasticNetParam=0.5, solver="l-bfgs").fit(x.where("date < date'1996-01-01'"))
    return model.transform(x.where("date >= date'1996-01-15'")).select("ticker", "date", F.round("prediction", 6).alias("prediction"))


@query("quote_gate", "quotes: SELECT event_id FROM quotes WHERE bid > 0 AND ask > bid AND (ask - bid) / ((ask + bid) / 2) * 10000 <= 15 AND ticker NOT IN ('signup')")
def quote_gate(spark, d):
    q = t.quotes(spark, d).where("ticker <> 'signup'")
    return q.where(market.spread_bps(F.col("bid"), F.col("ask")) <= 15).select("event_id")
