"""Table maintenance as pure functions: latest-wins, insert-new, upsert, versioned replace, comparison of books and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best(df: DataFrame, keys: Sequence[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order; the limit is pushed into the window, before the shuffle."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def replace_version(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """All rows of the versions in ``new`` replaced by it."""
    return old.join(new.select(version).distinct(), version, "left_anti").unionByName(new, allowMissingColumns=True)


def book_diff(new: DataFrame, old: DataFrame, key: str, weight: str, least: float) -> DataFrame:
    """Buys, sells and rebalances above ``least`` between two books."""
    n, o = new.select(key, F.col(weight).alias("__n")), old.select(key, F.col(weight).alias("__o"))
    j = n.join(o, key, "full")
    delta = F.coalesce("__n", F.lit(0.0)) - F.coalesce("__o", F.lit(0.0))
    action = F.when(F.col("__o").isNull(), "buy").when(F.col("__n").isNull(), "sell").otherwise("rebalance")
    return j.where(F.col("__o").isNull() | F.col("__n").isNull() | (F.abs(delta) > least)).select(key, action.alias("action"), F.round(delta, 6).alias("delta"))


def set_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Distinct rows of one side only, marked ``missing`` or ``extra``."""
    return expected.subtract(actual).withColumn("side", F.lit("missing")).union(actual.subtract(expected).withColumn("side", F.lit("extra")))
