"""Gates, joins, aggregates, upserts and top-k: the relational core."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators import asof, tables as up
from tidemark.plans import tables as t
from tidemark.registry import query
from tidemark.session import load

CUT = "1997-06-30"


@query("pit_gate", f"disc: SELECT trade_id, member, filing_date FROM disc WHERE filing_date <= DATE '{CUT}'")
def pit_gate(spark, d):
    return market.known_by(t.disclosures(spark, d), "filing_date", F.lit(CUT).cast("date")).select("trade_id", "member", "filing_date")


@query("asset_gate", "SELECT o_custkey AS member, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderpriority LIKE '1%' GROUP BY 1")
def asset_gate(spark, d):
    o = load(spark, d, "orders").where(F.col("o_orderpriority").like("1%"))
    return market.known_by(o, "o_orderdate", F.lit("1996-01-01").cast("timestamp")).groupBy(F.col("o_custkey").alias("member")).agg(F.count("*").alias("n"))


@query("latest_value_argmax", "prices: SELECT ticker, max(date) AS date, round(arg_max(close, date), 6) AS close FROM prices GROUP BY 1")
def latest_value_argmax(spark, d):
    return t.prices(spark, d).groupBy("ticker").agg(F.max("date").alias("date"), F.round(F.max_by("close", "date"), 6).alias("close"))


@query("universe_having", """prices: SELECT ticker, count(*) AS days, round(avg(close * volume), 4) AS adv, round(arg_max(close, date), 6) AS last_close FROM prices
  WHERE ticker NOT LIKE '%X' GROUP BY 1 HAVING count(*) >= 40 AND avg(close * volume) >= 1000 AND arg_max(close, date) >= 5 ORDER BY adv DESC, ticker LIMIT 4""")
def universe_having(spark, d):
    g = t.prices(spark, d).where(~F.col("ticker").like("%X")).groupBy("ticker").agg(F.count("*").alias("days"), F.avg(F.col("close") * F.col("volume")).alias("adv"), F.max_by("close", "date").alias("last_close"))
    return g.where("days >= 40 and adv >= 1000 and last_close >= 5").withColumns({"adv": F.round("adv", 4), "last_close": F.round("last_close", 6)}).orderBy(F.desc("adv"), "ticker").limit(4)


@query("amount_buckets", "SELECT CASE WHEN o_totalprice IS NULL THEN 'unknown' WHEN o_totalprice < 15000 THEN '<15K' WHEN o_totalprice < 50000 THEN '15-50K' WHEN o_totalprice < 100000 THEN '50-100K' WHEN o_totalprice < 250000 THEN '100-250K' ELSE '250K+' END AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def amount_buckets(spark, d):
    b = market.bucket(F.col("o_totalprice"), ((15000, "<15K"), (50000, "15-50K"), (100000, "50-100K"), (250000, "100-250K")), "250K+")
    return load(spark, d, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("size_bucket_universe", "SELECT s_suppkey AS id, CASE WHEN s_acctbal IS NULL THEN 'unknown' WHEN s_acctbal < 0 THEN 'small' WHEN s_acctbal < 4000 THEN 'mid' WHEN s_acctbal < 8000 THEN 'large' ELSE 'mega' END AS size FROM supplier")
def size_bucket_universe(spark, d):
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), market.bucket(F.col("s_acctbal"), ((0, "small"), (4000, "mid"), (8000, "large")), "mega").alias("size"))


@query("hash_sample", "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 4 = 0")
def hash_sample(spark, d):
    return load(spark, d, "orders").where(market.hash_bucket(F.col("o_orderkey"), 4) == 0).select("o_orderkey")


@query("issuer_split", "SELECT c_custkey AS id, CASE WHEN CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 5 = 0 THEN 'sealed' ELSE 'development' END AS split FROM customer")
def issuer_split(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(market.hash_bucket(F.col("c_name"), 5) == 0, "sealed").otherwise("development").alias("split"))


@query("session_slots", """SELECT event_id, CAST(n AS DATE) AS session_date, CAST(hour(n) * 60 + minute(n) - 570 AS INT) AS slot FROM
  (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS n FROM events) WHERE isodow(n) <= 5 AND hour(n) * 60 + minute(n) BETWEEN 570 AND 959""")
def session_slots(spark, d):
    return market.regular_session(load(spark, d, "events"), "ts").select("event_id", "session_date", "slot")


@query("session_coarse_prefilter", """SELECT event_id FROM (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS n FROM events)
  WHERE hour(ts) * 60 + minute(ts) BETWEEN 13 * 60 + 30 AND 21 * 60 AND isodow(n) <= 5 AND hour(n) * 60 + minute(n) BETWEEN 570 AND 959""")
def session_coarse_prefilter(spark, d):
    e = load(spark, d, "events")
    m = F.hour("ts") * 60 + F.minute("ts")
    return market.regular_session(e.where(m.between(13 * 60 + 30, 21 * 60)), "ts").select("event_id")


@query("release_session", """SELECT event_id, CASE WHEN isodow(n) > 5 THEN 'UNKNOWN' WHEN m < 570 THEN 'BMO' WHEN m >= 960 THEN 'AMC' ELSE 'DURING' END AS session FROM
  (SELECT event_id, n, hour(n) * 60 + minute(n) AS m FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS n FROM events))""")
def release_session(spark, d):
    return load(spark, d, "events").select("event_id", market.release_session(F.col("ts")).alias("session"))


@query("entry_session_class", "SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 810 AND 1199 THEN 'INTRADAY' ELSE 'AFTER_HOURS' END AS entry FROM events")
def entry_session_class(spark, d):
    m = F.hour("ts") * 60 + F.minute("ts")
    return load(spark, d, "events").select("event_id", F.when(m.between(810, 1199), "INTRADAY").otherwise("AFTER_HOURS").alias("entry"))


@query("time_split_embargo", """disc: SELECT trade_id, CASE WHEN filing_date < DATE '1996-01-01' AND filing_date + 20 < DATE '1996-01-01' THEN 'train' WHEN filing_date < DATE '1996-01-01' THEN 'embargo'
  WHEN filing_date < DATE '1997-01-01' THEN 'validation' ELSE 'prospective' END AS bucket FROM disc""")
def time_split_embargo(spark, d):
    return t.disclosures(spark, d).select("trade_id", market.time_bucket(F.col("filing_date"), "1996-01-01", "1997-01-01", 20).alias("bucket"))


@query("left_join_chain", """disc, members: SELECT trade_id, sector, region, coalesce(nation, 'none') AS nation FROM disc LEFT JOIN members USING (member)""")
def left_join_chain(spark, d):
    return t.disclosures(spark, d).join(t.members(spark, d), "member", "left").select("trade_id", "sector", "region", F.coalesce("nation", F.lit("none")).alias("nation"))


@query("anti_join_pending", "SELECT c_custkey AS member FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01' WHERE o_orderkey IS NULL")
def anti_join_pending(spark, d):
    recent = load(spark, d, "orders").where("o_orderdate >= timestamp'1997-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(recent, "c_custkey", "left_anti").select(F.col("c_custkey").alias("member"))


@query("semi_traded", "SELECT DISTINCT p_partkey, p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45")
def semi_traded(spark, d):
    traded = load(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").join(traded, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("json_field_filter", "quotes: SELECT ticker, k, count(*) AS n FROM quotes WHERE k % 2 = 0 GROUP BY 1, 2")
def json_field_filter(spark, d):
    return t.quotes(spark, d).where("k % 2 = 0").groupBy("ticker", "k").agg(F.count("*").alias("n"))


@query("json_update_semi", "SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) = 0) THEN 'flagged' ELSE 'ok' END AS status FROM events")
def json_update_semi(spark, d):
    e = load(spark, d, "events")
    bad = e.where(F.get_json_object("props", "$.k").cast("int") == 0).select("user_id", F.lit(True).alias("hit")).distinct()
    return e.join(bad, "user_id", "left").select("event_id", F.when(F.col("hit"), "flagged").otherwise("ok").alias("status"))


@query("conditional_sum_audit", """prices: WITH last AS (SELECT max(date) AS d FROM prices), per AS (SELECT ticker, max(date) AS m, count(*) AS n FROM prices GROUP BY 1)
  SELECT count(*) AS tickers, CAST(sum(CASE WHEN m < d - 1 THEN 1 ELSE 0 END) AS BIGINT) AS stale, CAST(sum(CASE WHEN n >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS deep FROM per, last""")
def conditional_sum_audit(spark, d):
    p = t.prices(spark, d)
    per = p.groupBy("ticker").agg(F.max("date").alias("m"), F.count("*").alias("n"))
    return per.crossJoin(per.agg(F.max("m").alias("d"))).agg(F.count("*").alias("tickers"), F.count_if(F.col("m") < F.date_sub("d", 1)).alias("stale"), F.count_if(F.col("n") >= 1000).alias("deep"))


@query("mode_name", """SELECT c_nationkey AS nation, c_mktsegment AS mode FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r
  FROM customer GROUP BY 1, 2) WHERE r = 1""")
def mode_name(spark, d):
    n = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"))
    return up.best(n, ["nation"], F.desc("n"), "c_mktsegment").select("nation", F.col("c_mktsegment").alias("mode"))


@query("feed_topk", "disc, members: SELECT trade_id, name, amount FROM disc JOIN members USING (member) WHERE tx_type = 'PURCHASE' ORDER BY amount DESC, trade_id LIMIT 50")
def feed_topk(spark, d):
    return t.disclosures(spark, d).where("tx_type = 'PURCHASE'").join(t.members(spark, d), "member").select("trade_id", "name", "amount").orderBy(F.desc("amount"), "trade_id").limit(50)


@query("leaderboard", "disc, members: SELECT member, name, count(*) AS n, round(avg(amount), 4) AS mean FROM disc JOIN members USING (member) GROUP BY 1, 2 HAVING count(*) >= 12 ORDER BY mean DESC, member LIMIT 25")
def leaderboard(spark, d):
    g = t.disclosures(spark, d).groupBy("member").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean")).where("n >= 12")
    return g.join(t.members(spark, d).select("member", "name"), "member").orderBy(F.desc("mean"), "member").limit(25)


@query("best_per_day", "disc: SELECT filing_date, trade_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY filing_date ORDER BY amount DESC, trade_id) AS r FROM disc) WHERE r = 1")
def best_per_day(spark, d):
    return up.best(t.disclosures(spark, d), ["filing_date"], F.desc("amount"), "trade_id").select("filing_date", "trade_id", "amount")


@query("dedupe_latest", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_latest(spark, d):
    return up.best(load(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("dedupe_first_wins", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedupe_first_wins(spark, d):
    return up.best(load(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("insert_new_only", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def insert_new_only(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return up.insert_new(o.where("o_orderdate < timestamp'1996-01-01'"), o.where("o_orderdate >= timestamp'1995-06-01'"), ["o_orderkey"]).drop("o_orderdate")


@query("delete_insert_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def delete_insert_upsert(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return up.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])


@query("update_from_join", "SELECT o_orderkey, coalesce(t.ticker, 'none') AS ticker FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS ticker FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey")
def update_from_join(spark, d):
    new = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("ticker"))
    return load(spark, d, "orders").select("o_orderkey", F.lit("none").alias("old")).join(new, "o_orderkey", "left").select("o_orderkey", F.coalesce("ticker", "old").alias("ticker"))


@query("repair_exists", """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'returned'
  WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'empty' ELSE 'kept' END AS status FROM orders""")
def repair_exists(spark, d):
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return load(spark, d, "orders").join(li, "o_orderkey", "left").select("o_orderkey", F.when(F.col("r"), "returned").when(F.col("r").isNull(), "empty").otherwise("kept").alias("status"))


@query("book_diff", """prices: WITH m AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r, close * volume AS v FROM prices), s AS (SELECT ticker, r, v / sum(v) OVER (PARTITION BY r) AS w FROM m WHERE r <= 2 AND NOT (r = 1 AND ticker LIKE 'S%') AND NOT (r = 2 AND ticker LIKE 'P%'))
  SELECT coalesce(n.ticker, o.ticker) AS ticker, CASE WHEN o.w IS NULL THEN 'buy' WHEN n.w IS NULL THEN 'sell' ELSE 'rebalance' END AS action, round(coalesce(n.w, 0) - coalesce(o.w, 0), 6) AS delta
  FROM (SELECT * FROM s WHERE r = 1) n FULL JOIN (SELECT * FROM s WHERE r = 2) o ON n.ticker = o.ticker WHERE o.w IS NULL OR n.w IS NULL OR abs(n.w - o.w) > 0.005""")
def book_diff(spark, d):
    p = t.prices(spark, d).withColumns({"r": F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date"))), "v": F.col("close") * F.col("volume")}).where("r <= 2")
    p = p.where("not (r = 1 and ticker like 'S%') and not (r = 2 and ticker like 'P%')").withColumn("w", F.col("v") / F.sum("v").over(W.partitionBy("r")))
    return up.book_diff(p.where("r = 1").select("ticker", "w"), p.where("r = 2").select("ticker", "w"), "ticker", "w", 0.005)


@query("session_intersection", "prices: SELECT date FROM prices WHERE ticker LIKE 'S%' INTERSECT SELECT date FROM prices WHERE ticker LIKE 'P%'")
def session_intersection(spark, d):
    p = t.prices(spark, d)
    return p.where("ticker like 'S%'").select("date").intersect(p.where("ticker like 'P%'").select("date"))


@query("set_symbol_mismatch", "SELECT key, side FROM (SELECT p_brand AS key, 'missing' AS side FROM part WHERE p_size > 48 EXCEPT SELECT p_brand, 'missing' FROM part WHERE p_size < 3) UNION ALL SELECT key, side FROM (SELECT p_brand AS key, 'extra' AS side FROM part WHERE p_size < 3 EXCEPT SELECT p_brand, 'extra' FROM part WHERE p_size > 48)")
def set_symbol_mismatch(spark, d):
    p = load(spark, d, "part")
    return up.set_mismatch(p.where("p_size > 48").select(F.col("p_brand").alias("key")), p.where("p_size < 3").select(F.col("p_brand").alias("key")))


@query("universe_union", "SELECT p_type AS symbol FROM part UNION SELECT event_type FROM events UNION SELECT n_name FROM nation")
def universe_union(spark, d):
    return load(spark, d, "part").select(F.col("p_type").alias("symbol")).union(load(spark, d, "events").select("event_type")).union(load(spark, d, "nation").select("n_name")).distinct()


@query("last_two_dates", "prices: SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 2")
def last_two_dates(spark, d):
    return t.prices(spark, d).select("date").distinct().orderBy(F.desc("date")).limit(2)


@query("store_stats", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, min(event_id) AS lo, max(event_id) AS hi FROM events")
def store_stats(spark, d):
    return load(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("layer_counts", "SELECT event_type AS layer, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC")
def layer_counts(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("layer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("group_stats_t", "disc: SELECT tx_type, count(*) AS n, round(avg(amount), 4) AS mean, round(CASE WHEN count(*) > 2 AND stddev_samp(amount) > 0 THEN avg(amount) / (stddev_samp(amount) / sqrt(count(*))) END, 4) AS t FROM disc GROUP BY 1")
def group_stats_t(spark, d):
    return t.disclosures(spark, d).groupBy("tx_type").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean"), F.round(market.t_stat("amount"), 4).alias("t"))


@query("segment_stats", "brets: SELECT ticker, count(ret) AS n, round(avg(ret) * 10000, 4) AS mean_bps, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(CASE WHEN ret > 0 THEN ret END), 6) AS avg_win, round(avg(CASE WHEN ret <= 0 THEN ret END), 6) AS avg_loss FROM brets WHERE ret IS NOT NULL GROUP BY 1")
def segment_stats(spark, d):
    r = t.returns(t.bars(spark, d), at="ts").where("ret is not null")
    return r.groupBy("ticker").agg(F.count("ret").alias("n"), F.round(F.avg("ret") * 10000, 4).alias("mean_bps"), F.round(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 6).alias("hit"), F.round(F.avg(F.when(F.col("ret") > 0, F.col("ret"))), 6).alias("avg_win"), F.round(F.avg(F.when(F.col("ret") <= 0, F.col("ret"))), 6).alias("avg_loss"))


@query("collapse_by_ticker", "disc: SELECT ticker, max(amount) AS best, arg_max(trade_id, amount) AS trade_id, count(DISTINCT member) AS members, array_to_string(list_sort(list(DISTINCT tx_type)), ',') AS kinds FROM disc WHERE ticker IS NOT NULL GROUP BY 1")
def collapse_by_ticker(spark, d):
    return t.disclosures(spark, d).where("ticker is not null").groupBy("ticker").agg(F.max("amount").alias("best"), F.max_by("trade_id", "amount").alias("trade_id"), F.count_distinct("member").alias("members"), F.array_join(F.sort_array(F.collect_set("tx_type")), ",").alias("kinds"))


@query("decile_table", """disc: WITH e AS (SELECT quantile_cont(amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM disc)
  SELECT CAST(len(list_filter(q, lambda x: amount > x)) AS INT) AS bin, count(*) AS n, round(avg(amount), 4) AS mean FROM disc, e GROUP BY 1""")
def decile_table(spark, d):
    return market.quantile_table(t.disclosures(spark, d), "amount", 10)


@query("tercile_split", "disc: WITH e AS (SELECT quantile_cont(amount, 0.33) AS lo, quantile_cont(amount, 0.67) AS hi FROM disc) SELECT CASE WHEN amount <= lo THEN 'low' WHEN amount >= hi THEN 'high' ELSE 'mid' END AS part, count(*) AS n FROM disc, e GROUP BY 1")
def tercile_split(spark, d):
    x = t.disclosures(spark, d)
    lo, hi = (F.lit(q).cast("double") for q in market.quantiles(x, "amount", [0.33, 0.67]))
    return x.groupBy(F.when(F.col("amount") <= lo, "low").when(F.col("amount") >= hi, "high").otherwise("mid").alias("part")).agg(F.count("*").alias("n"))


@query("coverage_grouping_sets", "disc: SELECT coalesce(tx_type, 'ALL') AS tx_type, coalesce(CAST(year(filing_date) AS VARCHAR), 'ALL') AS yr, count(*) AS n, round(avg(CASE WHEN ticker IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, count(*) >= 30 AS enough FROM disc GROUP BY GROUPING SETS ((tx_type), (year(filing_date)), (tx_type, year(filing_date)), ())")
def coverage_grouping_sets(spark, d):
    x = t.disclosures(spark, d).withColumn("yr", F.year("filing_date").cast("string"))
    g = x.groupingSets([["tx_type"], ["yr"], ["tx_type", "yr"], []], "tx_type", "yr").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("ticker").isNull(), 0.0).otherwise(1.0)), 6).alias("coverage"))
    return g.select(F.coalesce("tx_type", F.lit("ALL")).alias("tx_type"), F.coalesce("yr", F.lit("ALL")).alias("yr"), "n", "coverage", (F.col("n") >= 30).alias("enough"))


@query("concentration_top5", "disc: WITH m AS (SELECT member, count(*) AS n, sum(amount) AS v, row_number() OVER (ORDER BY sum(amount) DESC, member) AS r FROM disc GROUP BY 1) SELECT round(sum(CASE WHEN r <= 5 THEN v END) / sum(v), 6) AS value_share, round(sum(CASE WHEN r <= 5 THEN n END) * 1.0::DOUBLE / sum(n), 6) AS count_share FROM m")
def concentration_top5(spark, d):
    m = t.disclosures(spark, d).groupBy("member").agg(F.count("*").alias("n"), F.sum("amount").alias("v"))
    top = m.orderBy(F.desc("v"), "member").limit(5).agg(F.sum("v").alias("tv"), F.sum("n").alias("tn"))
    return m.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).crossJoin(top).select(F.round(F.col("tv") / F.col("v"), 6).alias("value_share"), F.round(F.col("tn") / F.col("n"), 6).alias("count_share"))


@query("leave_one_out", "prices: WITH m AS (SELECT ticker, avg(close) AS x FROM prices GROUP BY 1), s AS (SELECT ticker, (sum(x) OVER () - x) / (count(*) OVER () - 1) AS loo FROM m) SELECT ticker, round(loo, 6) AS loo FROM s")
def leave_one_out(spark, d):
    m, w = t.prices(spark, d).groupBy("ticker").agg(F.avg("close").alias("x")), W.partitionBy()
    return m.select("ticker", F.round((F.sum("x").over(w) - F.col("x")) / (F.count("*").over(w) - 1), 6).alias("loo"))


@query("pivot_panel", "prices: SELECT date, " + ", ".join(f"round(avg(CASE WHEN ticker = '{x}' THEN close END), 6) AS {x.lower()}" for x in ("ECONOMY", "PROMO", "STANDARD")) + " FROM prices GROUP BY 1")
def pivot_panel(spark, d):
    p = t.prices(spark, d).groupBy("date").pivot("ticker", ["ECONOMY", "PROMO", "STANDARD"]).agg(F.round(F.avg("close"), 6))
    return p.toDF(*[c.lower() for c in p.columns])


@query("month_end_last", "prices: SELECT ticker, max(date) AS date, round(arg_max(close, date), 6) AS close FROM prices GROUP BY ticker, date_trunc('month', date)")
def month_end_last(spark, d):
    return t.prices(spark, d).groupBy("ticker", F.trunc("date", "MM").alias("m")).agg(F.max("date").alias("date"), F.round(F.max_by("close", "date"), 6).alias("close")).drop("m")


@query("daily_funding_sum", "SELECT CAST(ts AS DATE) AS date, round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1")
def daily_funding_sum(spark, d):
    return load(spark, d, "events").where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 4).alias("total"))


@query("completeness_ratio", """prices: WITH b AS (SELECT count(*) AS n FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS x FROM prices) WHERE isodow(x) <= 5)
  SELECT ticker, count(DISTINCT date) AS days, round(count(DISTINCT date) * 1.0::DOUBLE / max(n), 6) AS ratio, count(DISTINCT date) * 1.0::DOUBLE / max(n) >= 0.95 AS complete FROM prices, b GROUP BY 1""")
def completeness_ratio(spark, d):
    p = t.prices(spark, d)
    b = p.agg(F.min("date").alias("a"), F.max("date").alias("z")).select(F.explode(F.sequence("a", "z")).alias("x")).where(F.weekday("x") < 5).agg(F.count("*").alias("n"))
    g = p.groupBy("ticker").agg(F.count_distinct("date").alias("days")).crossJoin(b).withColumn("q", F.col("days") / F.col("n"))
    return g.select("ticker", "days", F.round("q", 6).alias("ratio"), (F.col("q") >= 0.95).alias("complete"))


@query("quote_coverage", "quotes: SELECT ticker, CAST(ts AS DATE) AS date, round(least(1.0::DOUBLE, count(DISTINCT date_trunc('minute', ts)) / 60.0::DOUBLE), 6) AS coverage FROM quotes GROUP BY 1, 2")
def quote_coverage(spark, d):
    return t.quotes(spark, d).groupBy("ticker", F.to_date("ts").alias("date")).agg(F.round(F.least(F.lit(1.0), F.count_distinct(F.date_trunc("minute", "ts")) / 60.0), 6).alias("coverage"))


@query("goldset_score", """WITH p AS (SELECT doc_id, CAST(regexp_matches(text, '!!|\\*\\*\\*|%%%') AS INT) AS pred FROM documents), j AS (SELECT l.doc_id, pred, 1 - quality AS y, lang FROM labels l JOIN p USING (doc_id) JOIN documents d ON d.doc_id = l.doc_id)
  SELECT lang, count(*) AS n, count(*) FILTER (WHERE pred = 1 AND y = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND y = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND y = 1) AS fn FROM j GROUP BY 1""".replace("\\\\", "\\"))
def goldset_score(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", F.regexp_like("text", F.lit(r"!!|\*\*\*|%%%")).cast("int").alias("pred"))
    j = load(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y")).join(docs, "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if((F.col("pred") == a) & (F.col("y") == b)).alias(c) for c, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1))])


@query("headline_norm", "headlines: SELECT event_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM headlines")
def headline_norm(spark, d):
    return t.headlines(spark, d).select("event_id", text.normalised(F.col("title")).alias("norm"))


@query("name_key", r"SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM customer")
def name_key(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.name_key(F.col("c_name")).alias("key"))


@query("source_tier", "SELECT page_id, CASE WHEN h LIKE '%.org' THEN 1 WHEN h LIKE '%.net' THEN 2 ELSE 3 END AS tier FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages)")
def source_tier(spark, d):
    return load(spark, d, "pages").select("page_id", text.source_tier(F.col("url"), ((".org", 1), (".net", 2)), 3).alias("tier"))


@query("members_capacity_filter", "members: SELECT sector, region, count(*) AS n FROM members WHERE balance > 0 AND upper(nation) NOT LIKE 'U%' GROUP BY 1, 2")
def members_capacity_filter(spark, d):
    return t.members(spark, d).where((F.col("balance") > 0) & ~F.upper("nation").like("U%")).groupBy("sector", "region").agg(F.count("*").alias("n"))


@query("known_latest_fact", "disc: SELECT member, arg_max(trade_id, (filing_date, trade_id)) AS trade_id FROM disc WHERE filing_date <= DATE '1996-06-30' GROUP BY 1")
def known_latest_fact(spark, d):
    return asof.latest_known(t.disclosures(spark, d), ["member"], "filing_date", F.lit("1996-06-30").cast("date"), ["trade_id"])
