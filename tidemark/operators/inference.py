"""Statistical inference: shrinkage, robust errors, bootstrap by hashed weights, multiple-trial corrections."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def eb_shrink(df: DataFrame, key: str, x: str, least_own: int = 5, z: float = 1.96) -> DataFrame:
    """Empirical-Bayes means per key: ``(key, n, raw, shrunk, low, high)``.

    The error of a mean uses the group's variance from ``least_own`` rows on, else the pooled one. The spread of true means is
    the weighted variance of raw means less their mean squared error, at least 1e-6. With fewer than two groups raw is returned.
    """
    g = df.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("raw"), F.var_samp(x).alias("v")).where("n > 0")
    a = df.agg(F.var_samp(x).alias("pv"), F.avg(x).alias("grand"))
    g = g.crossJoin(a).withColumn("se2", F.when(F.col("n") >= least_own, F.col("v")).otherwise(F.col("pv")) / F.col("n"))
    t = g.agg(F.sum(F.col("n") * F.pow(F.col("raw") - F.col("grand"), 2)).alias("s"), F.sum("n").alias("sn"), F.avg("se2").alias("mse"), F.count("*").alias("groups"))
    g = g.crossJoin(t).withColumn("tau2", F.greatest(F.lit(1e-6), F.col("s") / F.col("sn") - F.col("mse")))
    w = F.col("tau2") / (F.col("tau2") + F.col("se2"))
    shrunk = F.when(F.col("groups") < 2, F.col("raw")).otherwise(w * F.col("raw") + (1 - w) * F.col("grand"))
    g = g.withColumns({"shrunk": shrunk, "sd": F.sqrt(w * F.col("se2"))})
    return g.select(key, "n", "raw", "shrunk", (F.col("shrunk") - z * F.col("sd")).alias("low"), (F.col("shrunk") + z * F.col("sd")).alias("high"))


def hac(df: DataFrame, by: list[str], at: str, x: str, lags: int = 5) -> DataFrame:
    """Newey-West mean, standard error and t with Bartlett weights; autocovariances are divided by n."""
    o, whole = W.partitionBy(*by).orderBy(at), W.partitionBy(*by)
    d = df.withColumn("__e", F.col(x) - F.avg(x).over(whole))
    d = d.withColumns({f"__g{k}": F.col("__e") * F.lag("__e", k).over(o) for k in range(1, lags + 1)})
    n = F.count(x)
    lrv = F.sum(F.col("__e") * F.col("__e")) / n
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__g{k}"), F.lit(0.0)) / n
    g = d.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), lrv) / n).alias("se"))
    return g.withColumn("t", F.try_divide("mean", "se"))


#: Cumulative probabilities of Poisson(1) up to seven.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def draw_hash(cluster: str, seed: int) -> Column:
    """The first 32 bits of a hash of (seed, draw, cluster) as hex digits, the same on every run and on every machine."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", F.col(cluster).cast("string"))), 1, 8)


#: The least hashes of weights from one to eight, as hex digits; those in order are numbers in order.
LEAST = tuple(f"{math.ceil(p * 2**32):08x}" for p in POISSON)


def draw_weight(h: str) -> Column:
    """The Poisson(1) weight of a hash."""
    return sum((F.when(F.col(h) >= least, 1).otherwise(0) for least in LEAST), F.lit(0))


def draw_weights(clusters: DataFrame, cluster: str, draws: int, seed: int, weight: str) -> DataFrame:
    """``(cluster, draw, weight)`` of every cluster in every draw."""
    d = clusters.select(cluster).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return d.withColumn("__h", draw_hash(cluster, seed)).withColumn(weight, draw_weight("__h")).drop("__h")


def _interval(means: DataFrame, df: DataFrame, x: str, least: int) -> DataFrame:
    ci = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c)).alias(c)
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean")).crossJoin(F.broadcast(ci)).select("n", "mean", enough("low"), enough("high"))


def cluster_bootstrap(df: DataFrame, cluster: str, x: str, draws: int = 2000, seed: int = 7, least: int = 20) -> DataFrame:
    """Bootstrap of a mean by clusters: one row with n, mean, low and high (95%); no interval below ``least`` rows.

    Clusters are summed first, so draws x clusters rows are made, not draws x rows.
    """
    g = df.groupBy(cluster).agg(F.sum(x).alias("__s"), F.count(x).alias("__c"))
    means = g.join(draw_weights(g, cluster, draws, seed, "w"), cluster).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("__s")), F.sum(F.col("w") * F.col("__c"))).alias("m"))
    return _interval(means, df, x, least)


def two_way_bootstrap(df: DataFrame, one: str, two: str, x: str, draws: int = 2000, seed: int = 23, least: int = 20) -> DataFrame:
    """The same by two crossed ways: a row weighs the product of the weights of its two clusters, drawn apart.

    Cells of both ways are summed first and stand together by the first way, whose weights are computed where they stand; what is left per
    cluster of the second way and draw gets its weight in the same manner. No table of weights is made, so none is joined or broadcast.
    """
    g = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(one, two).agg(F.sum(x).alias("__s"), F.count(x).alias("__c"))
    own = g.groupBy(one).agg(F.collect_list(F.struct(F.col(two).alias("__two"), "__s", "__c")).alias("__cells"))
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__h", draw_hash(one, seed)).where(F.col("__h") >= LEAST[0])
    cells = drawn.select("draw", draw_weight("__h").alias("w"), F.inline("__cells"))
    part = cells.groupBy("__two", "draw").agg(F.sum(F.col("w") * F.col("__s")).alias("__s"), F.sum(F.col("w") * F.col("__c")).alias("__c"))
    part = part.withColumn("__h", draw_hash("__two", seed + 1)).where(F.col("__h") >= LEAST[0]).withColumn("w", draw_weight("__h"))
    means = part.groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("__s")), F.sum(F.col("w") * F.col("__c"))).alias("m"))
    return _interval(means, df, x, least)


def block_bootstrap(df: DataFrame, at: str, x: str, block: int = 21, draws: int = 200, seed: int = 7) -> DataFrame:
    """Moving-block bootstrap of the mean of a series: blocks of ``block`` rows from hashed starts, joined by row number."""
    s = df.select(F.row_number().over(W.orderBy(at)).alias("i"), F.col(x).alias("x"))
    n = s.agg(F.count("*").alias("n"))
    need = n.select(F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), "n").withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), "draw", "b"), F.col("n") - block + 1) + 1
    need = need.withColumn("start", start).withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + block - 1)))
    means = need.join(s, "i").groupBy("draw").agg(F.avg("x").alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def sharpe_moments(x: str) -> list[Column]:
    """n, Sharpe per period (sample sd), skewness and raw kurtosis."""
    return [F.count(x).alias("n"), (F.avg(x) / F.stddev_samp(x)).alias("sr"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt")]


def normal_cdf(z: Column) -> Column:
    """Abramowitz-Stegun 26.2.17, error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def probabilistic_sharpe(sr: Column, against: Column | float, n: Column, skew: Column, kurt: Column) -> Column:
    return normal_cdf((sr - against) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Expected largest Sharpe of unskilled trials."""
    q, gamma = NormalDist().inv_cdf, 0.5772156649015329
    return variance**0.5 * ((1 - gamma) * q(1 - 1 / trials) + gamma * q(1 - 1 / (trials * 2.718281828459045)))


def power_n(effect: float, sd: float, alpha: float = 0.05, power: float = 0.8) -> float:
    q = NormalDist().inv_cdf
    return ((q(1 - alpha / 2) + q(power)) * sd / effect) ** 2


def permuted(df: DataFrame, strata: list[str], x: str, key: str, seed: int = 7) -> DataFrame:
    """``x`` permuted within strata: the r-th row by key gets the value of the r-th row by hash; the multiset stays."""
    w = W.partitionBy(*strata)
    a = df.withColumn("__r", F.row_number().over(w.orderBy(key)))
    b = df.select(*strata, F.col(x).alias("permuted"), F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key)).alias("__r"))
    return a.join(b, [*strata, "__r"]).drop("__r")


def multiway_meat(df: DataFrame, clusters: list[list[str]], terms: list[tuple[str, str]]) -> DataFrame:
    """Cluster-robust score products by inclusion and exclusion: for each pair of score columns the signed sum over cluster sets."""
    out = None
    for bits in range(1, 1 << len(clusters)):
        keys = [k for i, c in enumerate(clusters) if bits >> i & 1 for k in c]
        sign = 1 if bin(bits).count("1") % 2 else -1
        cols = sorted({c for pair in terms for c in pair})
        g = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols]).agg(*[(sign * F.sum(F.col(a) * F.col(b))).alias(f"{a}_{b}") for a, b in terms])
        out = g if out is None else out.union(g)
    return out.agg(*[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a, b in terms])
