"""Panel operators over long tables: trailing windows, forward returns, cross sections. Each keeps the table long."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_index(dates: DataFrame, at: str = "date") -> DataFrame:
    """``(date, idx)``, 1 for the first session; one row per trading day, so a single ordered pass is small."""
    return dates.select(at).distinct().withColumn("idx", F.row_number().over(W.orderBy(at)))


def trailing(by: Sequence[str] | str, at: Sequence[str] | str, width: int, lag: int = 1):
    """The ``width`` rows that end ``lag`` rows before the current one."""
    return W.partitionBy(by).orderBy(at).rowsBetween(-(width + lag - 1), -lag)


def full(stat: Column, count_of: Column, w, least: int) -> Column:
    """``stat`` over ``w`` where the window holds at least ``least`` non-null values, else NULL."""
    return F.when(F.count(count_of).over(w) >= least, stat)


def past_z(x: str, by: str, at: str, width: int) -> Column:
    """z-score against the ``width`` strictly earlier values; NULL unless all are there and they differ (population sd)."""
    w = trailing(by, at, width)
    sd = F.stddev_pop(x).over(w)
    return full(F.when(sd > 0, (F.col(x) - F.avg(x).over(w)) / sd), F.col(x), w, width)


def rolling_beta(y: str, x: str, by: str, at: str, width: int, mixed: bool = False) -> Column:
    """Slope of y on x over strictly earlier rows; ``mixed`` divides the sample covariance by the population variance."""
    w = trailing(by, at, width)
    var = (F.var_pop(x) if mixed else F.var_samp(x)).over(w)
    return full(F.when(var > 0, F.covar_samp(y, x).over(w) / var), F.col(y) + F.col(x), w, width)


def two_factor_residual(y: str, a: str, b: str, by: str, at: str, width: int) -> tuple[Column, Column, Column]:
    """(beta a, beta b, residual) of y on two factors over strictly earlier rows in closed form. The means serve the betas only:
    the residual is what the two factors do not explain, the intercept included. Give factor b in excess of factor a, lest the two be nearly collinear."""
    w = trailing(by, at, width)
    m = lambda e: F.avg(e).over(w)
    cov = lambda p, q: m(F.col(p) * F.col(q)) - m(F.col(p)) * m(F.col(q))
    saa, sbb, sab, say, sby = cov(a, a), cov(b, b), cov(a, b), cov(a, y), cov(b, y)
    det = saa * sbb - sab * sab
    ok = (F.count(F.col(y) + F.col(a) + F.col(b)).over(w) >= width) & (F.abs(det) > 1e-14)
    ba, bb = F.when(ok, (say * sbb - sby * sab) / det), F.when(ok, (sby * saa - say * sab) / det)
    return ba, bb, F.col(y) - ba * F.col(a) - bb * F.col(b)


def rolling_median(x: str, w, least: int = 1) -> Column:
    return full(F.percentile(x, 0.5).over(w), F.col(x), w, least)


def average_rank(x: str, by: Sequence[str] | str) -> Column:
    """Rank from 1 with ties at their mean."""
    own = W.partitionBy(by).orderBy(x)
    ties = W.partitionBy([*([by] if isinstance(by, str) else by), x])
    return F.rank().over(own) + (F.count("*").over(ties) - 1) / 2.0


def demean(x: str, by: Sequence[str] | str) -> Column:
    return F.col(x) - F.avg(x).over(W.partitionBy(by))


def forward_return(prices: DataFrame, sessions: DataFrame, events: DataFrame, day: str, horizon: int, strict: bool = False) -> DataFrame:
    """Adds ``entry_idx``, ``entry_px``, ``exit_px`` and ``fwd`` to events with a ``ticker``.

    Entry is the first session on or after ``day`` (after it with ``strict``) and exit ``horizon`` sessions later; both prices must exist.
    The session of a day is found over calendar days that are densified once, so the join is an equi-join.
    """
    cal = next_session(sessions, strict)
    px = prices.join(sessions, "date").select("ticker", "idx", "close")
    e = events.join(cal.select(F.col("day").alias(day), F.col("idx").alias("entry_idx")), day, "left")
    e = e.join(px.select("ticker", F.col("idx").alias("entry_idx"), F.col("close").alias("entry_px")), ["ticker", "entry_idx"], "left")
    e = e.join(px.select("ticker", (F.col("idx") - horizon).alias("entry_idx"), F.col("close").alias("exit_px")), ["ticker", "entry_idx"], "left")
    return e.withColumn("fwd", F.try_divide("exit_px", "entry_px") - 1)


def next_session(sessions: DataFrame, strict: bool = False, before: int = 60) -> DataFrame:
    """``(day, idx)`` for every calendar day from ``before`` days ahead of the first session to the last: the session on or after it."""
    s = sessions.withColumn("prev", F.lag("date").over(W.orderBy("date")))
    first = F.coalesce(F.date_add("prev", 0 if strict else 1), F.date_sub("date", before))
    return s.select(F.explode(F.sequence(first, F.date_sub("date", 1) if strict else F.col("date"))).alias("day"), "idx")


def densify(df: DataFrame, keys: str, at: str) -> DataFrame:
    """Every key at every time that any key has, in long form; values are NULL where the row is missing."""
    times = df.agg(F.collect_set(at).alias("__t"))
    return df.select(keys).distinct().crossJoin(times).select(keys, F.explode("__t").alias(at)).join(df, [keys, at], "left")


def factor_car(rows: DataFrame, factors: Sequence[str], horizon: int, width: int = 252, gap: int = 10, least: int = 100) -> DataFrame:
    """Adds ``car``: the return from the open of a session over ``horizon`` sessions, less what the factors explain; NULL where betas or sessions lack.

    ``rows`` has ``ticker, idx, open, close, ret, rf`` and the factors of the session. Betas come from least squares with intercept over the ``width``
    sessions that end ``gap`` before the row (``least`` complete ones at least). The window's moments are differences of two running sums, so each row costs
    the same whatever the width; only the small systems are solved in Python. Sessions without a return add nothing, those without a factor add the whole return.
    """
    o = W.partitionBy("ticker").orderBy("idx")
    until = lambda k: o.rangeBetween(W.unboundedPreceding, -k)
    y = F.when(F.greatest(*[F.col(f).isNull() for f in (*factors, "ret", "rf")]), None).otherwise(F.col("ret") - F.col("rf"))
    x = rows.withColumn("__y", y)
    terms = [F.lit(1.0), *[F.col(f) for f in factors], F.col("__y")]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    moment = lambda i, j, w: F.coalesce(F.sum(F.when(F.col("__y").isNotNull(), terms[i] * terms[j])).over(w), F.lit(0.0))
    x = x.withColumn("__m", F.array(*[moment(i, j, until(gap + 1)) - moment(i, j, until(gap + width + 1)) for i, j in pairs]))
    n = len(terms)

    @F.pandas_udf("array<double>")
    def betas(moments: pd.Series) -> pd.Series:
        m = np.zeros((len(moments), n, n))
        for k, (i, j) in enumerate(pairs):
            m[:, i, j] = m[:, j, i] = [v[k] for v in moments]
        # centred and brought to one scale, lest small factors drown in the constant
        a, b, count = m[:, 1:-1, 1:-1], m[:, 1:-1, -1], np.maximum(m[:, 0, 0], 1)
        mean, top = m[:, 0, 1:-1] / count[:, None], m[:, 0, -1] / count
        a = a - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        b = b - count[:, None] * mean * top[:, None]
        scale = np.sqrt(np.maximum(np.einsum("kii->ki", a), 1e-300))
        solved = np.linalg.pinv(a / (scale[:, :, None] * scale[:, None, :]), rcond=1e-10) @ (b / scale)[:, :, None]
        return pd.Series(list(solved[:, :, 0] / scale))

    x = x.withColumn("__b", betas("__m"))
    beta = F.when(F.element_at("__m", 1) >= least, F.col("__b"))
    known = F.greatest(*[F.col(f).isNull() for f in (*factors, "rf")]) == F.lit(False)
    later = o.rangeBetween(1, horizon - 1)
    hold = lambda c: F.coalesce(F.sum(F.when(F.col("ret").isNotNull() & known, c)).over(later), F.lit(0.0)) + F.when(known, c).otherwise(0.0)
    gained = F.col("close") / F.col("open") - 1 + F.coalesce(F.sum("ret").over(later), F.lit(0.0)) - hold(F.col("rf"))
    explained = sum((F.element_at(beta, i + 1) * hold(F.col(f)) for i, f in enumerate(factors)), F.lit(0.0))
    whole = x.crossJoin(F.broadcast(rows.agg(F.max("idx").alias("__last"))))  # one row
    car = F.when((F.col("open") > 0) & (F.col("idx") + horizon <= F.col("__last")), gained - explained)
    return whole.withColumn("car", car).drop("__y", "__m", "__b", "__last")
