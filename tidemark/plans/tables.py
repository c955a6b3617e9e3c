"""The market tables that the queries read, derived from the bundled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.panel import session_index
from tidemark.session import load


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars per ticker (event type)."""
    e = load(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("value", e.ts).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", e.ts).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("trades"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily prices per ticker (part type)."""
    li, part = load(spark, d, "lineitem"), load(spark, d, "part")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    joined = li.select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_type").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        F.min(unit).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def disclosures(spark: SparkSession, d: str) -> DataFrame:
    """Trades with their transaction and filing dates."""
    li, part = load(spark, d, "lineitem").select("l_orderkey", "l_partkey"), load(spark, d, "part").select("p_partkey", "p_type")
    ticker = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min("p_type").alias("ticker"))
    o, day = load(spark, d, "orders"), F.to_date("o_orderdate")
    kind = F.when(F.col("o_orderstatus") == "F", "PURCHASE").when(F.col("o_orderstatus") == "O", "SALE").otherwise("EXCHANGE")
    rows = o.select("o_orderkey", F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("member"), day.alias("tx_date"), F.date_add(day, (F.col("o_orderkey") % 45).cast("int")).alias("filing_date"), F.col("o_totalprice").alias("amount"), kind.alias("tx_type"))
    return rows.join(ticker, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("o_orderkey", "l_orderkey")


def members(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = load(spark, d, "customer"), load(spark, d, "nation"), load(spark, d, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("c_custkey").alias("member"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select(
        "event_id", F.col("event_type").alias("ticker"), "ts", "user_id", "value", k.alias("k"),
        (F.col("value") * (1 - k / 10000.0)).alias("bid"), (F.col("value") * (1 + k / 10000.0)).alias("ask"),
    )


def headlines(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp")
    return load(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.substring("text", 1, 120).alias("title"), F.col("source").alias("publisher"), "lang", F.timestamp_seconds(F.unix_timestamp(start) + F.col("doc_id") * 60).alias("public_time"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return session_index(prices(spark, d).select("date").distinct(), "date")


def returns(p: DataFrame, by: str = "ticker", at: str = "date") -> DataFrame:
    """Adds ``ret``, the simple return on the row before; NULL first, no filling."""
    return p.withColumn("ret", F.try_divide("close", F.lag("close").over(W.partitionBy(by).orderBy(at))) - 1)
