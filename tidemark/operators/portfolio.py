"""Flow bars, weights, turnover and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flow_bars(trades: DataFrame, width: str) -> DataFrame:
    """Bars of signed flow: even ``k`` buys, odd sells; size is k + 1. Empty buckets make no row. Works on a stream."""
    buy, sell = F.when(F.col("k") % 2 == 0, F.col("value")).otherwise(0.0), F.when(F.col("k") % 2 == 1, F.col("value")).otherwise(0.0)
    g = trades.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("trades"), F.sum(buy).alias("buy"), F.sum(sell).alias("sell"),
        (F.sum(F.col("value") * (F.col("k") + 1)) / F.sum(F.col("k") + 1)).alias("vwap"), F.max_by("value", F.col("ts")).alias("close"),
    )
    return g.select("ticker", F.col("w.start").alias("start"), "trades", "buy", "sell", F.try_divide(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")).alias("ofi"), "vwap", "close")


def cap_weights(df: DataFrame, by: list[str], weight: str, cap: float) -> DataFrame:
    """Weights held to ``cap`` with the excess shared in proportion (water-filling); what cannot be placed stays in cash.

    Closed form: sorted from the largest, the first j names are capped while the rest scale to 1 - j cap; the right j is the first whose
    next scaled weight is within the cap.
    """
    o = W.partitionBy(*by).orderBy(F.desc("__x"), *[c for c in df.columns if c not in (*by, weight)])
    whole = W.partitionBy(*by)
    x = df.withColumn("__x", F.col(weight) / F.sum(weight).over(whole))
    x = x.withColumns({"__i": F.row_number().over(o) - 1, "__left": F.sum("__x").over(o.rowsBetween(0, W.unboundedFollowing))})
    fits = F.col("__x") * F.try_divide(1 - F.col("__i") * cap, F.col("__left")) <= cap + 1e-12
    x = x.withColumn("__j", F.min(F.when(fits, F.col("__i"))).over(whole))
    rest = F.max(F.when(F.col("__i") == F.col("__j"), F.col("__left"))).over(whole)
    x = x.withColumn("__rest", rest)
    scaled = F.col("__x") * F.greatest(F.lit(0.0), 1 - F.col("__j") * cap) / F.col("__rest")
    return x.withColumn("capped", F.when(F.col("__j").isNull() | (F.col("__i") < F.col("__j")), F.lit(cap)).otherwise(scaled)).drop("__x", "__i", "__left", "__j", "__rest")


def turnover(weights: DataFrame, key: str, at: str, weight: str) -> DataFrame:
    """Sum of absolute weight changes per date; names that leave or enter count with their whole weight."""
    dates = weights.select(at).distinct().withColumn("next", F.lead(at).over(W.orderBy(at)))
    now = weights.select(key, at, F.col(weight).alias("w"))
    carried = now.join(dates, at).where("next is not null").select(key, F.col("next").alias(at), F.col("w").alias("before"))
    return now.join(carried, [key, at], "full").groupBy(at).agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("turnover"))
