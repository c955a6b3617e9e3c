"""As-of joins: the row before or after a time, by a union and one ordered pass over each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, values: Sequence[str],
    forward: bool = False, strict: bool = False, tolerance: float | None = None, where: Column | None = None, prefix: str = "",
) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row at or before its time (the first at or after it with ``forward``).

    ``strict`` excludes equal times. ``tolerance`` is in seconds; beyond it the values are NULL. ``where`` limits the right rows.
    Equal right times are broken by the values, the largest going backward and the smallest forward. One shuffle by key, one sort; nothing
    grows with the number of pairs.
    """
    right = right if where is None else right.where(where)
    r = right.select(*on, F.col(right_at).alias("__t"), F.struct(F.col(right_at).alias("__at"), *values).alias("__v"))
    lhs = left.withColumn("__row", F.struct(*left.columns)).select(*on, F.col(left_at).alias("__t"), "__row")
    both = lhs.withColumn("__v", F.lit(None).cast(r.schema["__v"].dataType)).unionByName(r.withColumn("__row", F.lit(None).cast(lhs.schema["__row"].dataType)))
    # at equal times the side that must not see the other comes first
    right_first = not strict
    side = F.when(F.col("__v").isNotNull(), 0 if right_first else 1).otherwise(1 if right_first else 0)
    at = F.col("__t").desc() if forward else F.col("__t").asc()
    w = W.partitionBy(*on).orderBy(at, side, F.col("__v").desc() if forward else F.col("__v").asc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("__m", F.last("__v", ignorenulls=True).over(w)).where("__row is not null")
    m = F.col("__m")
    if tolerance is not None:
        gap = F.abs(F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col("__m.__at").cast("timestamp"))) / 1e6
        m = F.when(gap <= tolerance, m)
    out = out.select("__row", m.alias("__m"))
    return out.select("__row.*", F.col("__m.__at").alias(prefix + "at"), *[F.col(f"__m.{v}").alias(prefix + v) for v in values])


def latest_known(facts: DataFrame, keys: Sequence[str], known_at: str, as_of: Column, values: Sequence[str]) -> DataFrame:
    """The latest row per key that was public at ``as_of``."""
    return facts.where(F.col(known_at) <= as_of).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(known_at, *values)).alias("v")).select(*keys, "v.*")


def interval_band(df: DataFrame, at: str, width_seconds: int, name: str = "__band") -> DataFrame:
    """The bucket of a time, for interval joins as equi-joins: one row per event."""
    return df.withColumn(name, F.floor(F.unix_timestamp(at) / width_seconds))


def within(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs with ``-before <= right time - left time <= after`` (seconds), found by an equi-join on time buckets.

    The right side is put into the buckets that it can reach, two or three rows each; the exact bounds follow.
    """
    width = max(before + after, 1)
    a = interval_band(left, left_at, width)
    t = F.unix_timestamp(right_at)
    b = right.withColumn("__band", F.explode(F.array_distinct(F.array(F.floor((t - after) / width), F.floor((t + before) / width), F.floor(t / width)))))
    gap = F.unix_timestamp(b[right_at]) - F.unix_timestamp(a[left_at])
    return a.join(b, [*on, "__band"]).where((gap >= -before) & (gap <= after)).drop("__band")
