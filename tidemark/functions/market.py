"""Scalar functions of times, sessions, sizes and costs."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCHANGE = "America/New_York"


def known_by(df: DataFrame, known_at: str, as_of: Column) -> DataFrame:
    """Only rows that were public at ``as_of``; a missing time is never known."""
    return df.where(F.col(known_at) <= as_of)


def hash_bucket(key: Column, buckets: int) -> Column:
    """A stable bucket of a key: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets


def bucket(x: Column, edges: tuple, top: str, unknown: str = "unknown") -> Column:
    """Label of the first edge that x lies below."""
    out = F.when(x.isNull(), unknown)
    for edge, label in edges:
        out = out.when(x < edge, label)
    return out.otherwise(top)


def local_minute(ts: Column) -> tuple[Column, Column]:
    """(exchange wall clock, minute of day) of a UTC time."""
    local = F.from_utc_timestamp(ts, EXCHANGE)
    return local, F.hour(local) * 60 + F.minute(local)


def regular_session(df: DataFrame, at: str) -> DataFrame:
    """Rows in 09:30-16:00 on weekdays with ``session_date`` and ``slot`` (minutes since the open, 0 to 389)."""
    local, minute = local_minute(F.col(at))
    return df.where((F.weekday(local) < 5) & minute.between(570, 959)).withColumns({"session_date": F.to_date(local), "slot": minute - 570})


def release_session(ts: Column) -> Column:
    local, minute = local_minute(ts)
    return F.when(F.weekday(local) > 4, "UNKNOWN").when(minute < 570, "BMO").when(minute >= 960, "AMC").otherwise("DURING")


def time_bucket(day: Column, split: str, end: str, embargo_days: int) -> Column:
    """train, validation, prospective; embargo where the outcome of a training row reaches the split."""
    s, e = F.lit(split).cast("date"), F.lit(end).cast("date")
    return F.when(F.date_add(day, embargo_days) < s, "train").when(day < s, "embargo").when(day < e, "validation").otherwise("prospective")


def t_stat(x: str) -> Column:
    n, sd = F.count(x), F.stddev_samp(x)
    return F.when((n > 2) & (sd > 0), F.avg(x) / (sd / F.sqrt(n)))


#: Fixed value: parts into which a range of values is cut.
PARTS = 1024


def quantiles(df: DataFrame, x: str, points: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, NULL left out, NaN last; without values each is None.

    The range that holds a wanted rank is cut into parts, by sign or of equal width, rows are counted by part, and the part with the rank is cut
    in its turn, down to single values. The least and the greatest value of a range always part, so every round goes on. Memory is bounded by the parts, not by
    the distinct values; each round reads the column once.
    """
    v = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"))
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(points)
    places = [(math.floor((n - 1) * p), math.ceil((n - 1) * p), (n - 1) * p) for p in points]
    at, open_ = {}, {(low, high): (0, sorted({r for lo, hi, _ in places for r in (lo, hi)}))}
    while open_:
        for (low, high), (_, ranks) in open_.items():
            if low == high or math.isnan(low):
                at |= dict.fromkeys(ranks, low)
        ranges = [(low, high, *rest) for (low, high), rest in open_.items() if rest[1][0] not in at]
        if not ranges:
            break
        which, part = F, F
        for i, (low, high, _, _) in enumerate(ranges):
            inside = F.col("v").between(low, high)
            which, part = which.when(inside, i), part.when(inside, _part(F.col("v"), low, high))
        counts = v.select("v", which.alias("i"), part.alias("p")).where("i is not null").groupBy("i", "p").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        open_ = {}
        found = sorted((r.i, r.p, r.c, r.low, r.high) for r in counts.collect())
        for i, (_, _, before, ranks) in enumerate(ranges):
            for _, _, c, low, high in (f for f in found if f[0] == i):
                if inner := [r for r in ranks if before <= r < before + c]:
                    open_[low, high] = (before, inner)
                before += c
    return [at[lo] if at[lo] == at[hi] else (hi - place) * at[lo] + (place - lo) * at[hi] for lo, hi, place in places]


def _part(v: Column, low: float, high: float) -> Column:
    """The part of ``v`` in a range, never falling as ``v`` grows; infinite values and NaN have parts of their own."""
    ends = F.when(F.isnan(v), PARTS + 2).when(v == math.inf, PARTS + 1).when(v == -math.inf, -1)
    low, high = max(low, -sys.float_info.max), sys.float_info.max if math.isnan(high) else min(high, sys.float_info.max)
    if high <= low:
        return ends.otherwise(0)
    if low <= 0 <= high:
        return ends.otherwise(F.signum(v).cast("int"))
    if high < 0:
        return ends.otherwise(-_part(-v, -high, -low))
    f = F.ln if high / PARTS > low else lambda c: c  # steep ranges by the logarithm
    start, end = f(F.lit(low)), f(F.lit(high))
    return ends.otherwise(F.floor((f(v) - start) / (end - start) * PARTS).cast("int"))


def quantile_table(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Count and mean by quantile bin; bins come from the empirical edges, so equal values share one."""
    edges = F.array(*[F.lit(q).cast("double") for q in quantiles(df, x, [i / bins for i in range(1, bins)])])
    b = F.size(F.filter(edges, lambda q: F.col(x) > q))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    """Quoted spread over mid; NULL for a missing, locked or crossed market."""
    return F.when((bid > 0) & (ask > bid), (ask - bid) / mid(bid, ask) * 10000)


def aggressor(price: Column, bid: Column, ask: Column, before: Column) -> Column:
    """Quote rule, then tick test at the mid; NULL in a locked or crossed market."""
    m = mid(bid, ask)
    tick = F.when(price > before, "BUY").when(price < before, "SELL")
    return F.when(bid >= ask, None).when(price >= ask, "BUY").when(price <= bid, "SELL").when(price > m, "BUY").when(price < m, "SELL").otherwise(tick)


def fill(side: Column, qty: Column, limit: Column, bid: Column, bid_size: Column, ask: Column, ask_size: Column, adverse_bps: float = 0.0, depth_bps: float = 0.0, depth_size: Column | None = None) -> Column:
    """Marketable-limit fill: struct(status, filled, price). The market may move against the order before it arrives."""
    buy = side == "BUY"
    px = F.when(buy, ask * (1 + adverse_bps / 1e4)).otherwise(bid * (1 - adverse_bps / 1e4))
    size = F.when(buy, ask_size).otherwise(bid_size)
    more = F.lit(0) if depth_size is None else depth_size
    ok = F.when(buy, px <= limit).otherwise(px >= limit) & (bid > 0) & (ask >= bid)
    filled = F.least(qty, size + (more if depth_bps else F.lit(0)))
    over = F.greatest(F.lit(0), filled - size)
    price = (px * (filled - over) + over * px * F.when(buy, 1 + depth_bps / 1e4).otherwise(1 - depth_bps / 1e4)) / F.nullif(filled, F.lit(0))
    status = F.when(~ok, "REJECTED").when(filled >= qty, "FILLED").when(filled > 0, "PARTIAL").otherwise("REJECTED")
    return F.struct(status.alias("status"), F.when(ok, filled).otherwise(0).alias("filled"), F.when(ok, price).alias("price"))


def round_trip_cost_bps(spread: Column, notional: Column, adv: Column, impact: float = 10.0) -> Column:
    """Both half-spreads and a square-root impact on each side."""
    return spread + 2 * impact * F.sqrt(F.greatest(F.lit(0.0), notional / F.nullif(adv, F.lit(0.0))))


def shrunk_beta(beta: Column, n: Column, strength: float = 20.0) -> Column:
    """Shrunk to 1 by sample size, then held to 0..2."""
    w = n / (n + strength)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), w * beta + (1 - w)))


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "Fri"), 14)
