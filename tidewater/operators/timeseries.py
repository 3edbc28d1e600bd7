"""Windowed features of return series. Every window is partitioned by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

X = "g"


def _by():
    return Window.partitionBy("ticker").orderBy("idx")


def rolling_kurtosis(returns: DataFrame, w: int) -> DataFrame:
    """Population excess kurtosis of the last w returns, from the w-th on."""
    return returns.withColumn("kurt", F.when(F.col("idx") >= w, F.kurtosis(X).over(_by().rowsBetween(1 - w, 0))))


def lagged_volatility(returns: DataFrame, w: int = 20) -> DataFrame:
    """Root mean square of the w returns before this one; the whole series' for the first."""
    before = F.sqrt(F.avg(F.col(X) ** 2).over(_by().rowsBetween(-w, -1)))
    return returns.withColumn("rv", F.coalesce(before, F.sqrt(F.avg(F.col(X) ** 2).over(Window.partitionBy("ticker")))))


def har_features(returns: DataFrame) -> DataFrame:
    """Squared return of the day before, and its means over 5 and 22 days before; from the 23rd row."""
    v = F.col(X) ** 2
    out = returns.select("ticker", "idx", v.alias("rv"), F.lag(v).over(_by()).alias("rv_d"), F.avg(v).over(_by().rowsBetween(-5, -1)).alias("rv_w"), F.avg(v).over(_by().rowsBetween(-22, -1)).alias("rv_m"))
    return out.where("idx > 22")


def har_sufficient_statistics(features: DataFrame) -> DataFrame:
    """What the normal equations of log rv on the logs of its features need."""
    logs = features.where("rv > 0 and rv_d > 0").select("ticker", *[F.log(c).alias(c) for c in ("rv", "rv_d", "rv_w", "rv_m")])
    names = ("rv_d", "rv_w", "rv_m")
    sums = [F.sum(c).alias(f"s_{c}") for c in ("rv", *names)]
    squares = [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    cross = [F.sum(F.col(a) * F.col("rv")).alias(f"s_{a}_y") for a in names]
    return logs.groupBy("ticker").agg(F.count("*").alias("n"), *sums, *squares, *cross)


def max_drawdown(returns: DataFrame, dt: float = 1 / 252) -> DataFrame:
    """Largest fall of the summed log growth from its running maximum."""
    run = F.sum(F.col(X) * dt).over(_by())
    out = returns.withColumn("run", run).withColumn("top", F.greatest(F.lit(0.0), F.max("run").over(_by())))
    return out.groupBy("ticker").agg(F.max(F.col("top") - F.col("run")).alias("max_drawdown"))


def prices(returns: DataFrame, start: float, dt: float = 1 / 252, rf: float = 0.0) -> DataFrame:
    """start * exp(sum of (g + rf) dt), with the start itself at step 0."""
    run = F.lit(start) * F.exp(F.sum((F.col(X) + rf) * dt).over(_by()))
    first = returns.select("ticker").distinct().select("ticker", F.lit(0).cast("long").alias("idx"), F.lit(start).alias("price"))
    return returns.select("ticker", "idx", run.alias("price")).unionByName(first)


def aggregated_kurtosis(returns: DataFrame, horizons: list[int]) -> DataFrame:
    """Population excess kurtosis of sums over non-overlapping blocks of h; null below 5 blocks."""
    rows = returns.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("block", F.floor((F.col("idx") - 1) / F.col("h")))
    sums = rows.groupBy("ticker", "h", "block").agg(F.sum(X).alias("s"), F.count("*").alias("n")).where("n = h")
    return sums.groupBy("ticker", "h").agg(F.count("*").alias("blocks"), F.when(F.count("*") >= 5, F.kurtosis("s")).alias("kurt"))


def leverage_profile(returns: DataFrame, lags: int = 20) -> DataFrame:
    """corr(r_{t-k}, r_t^2) for k = 1..lags: a join of each step to those k before."""
    a = returns.select("ticker", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "idx", F.col(X).alias("x")).withColumn("idx", F.col("idx") + F.col("lag"))
    b = returns.select("ticker", "idx", (F.col(X) ** 2).alias("y"))
    return a.join(b, ["ticker", "idx"]).groupBy("ticker", "lag").agg(F.corr("x", "y").alias("rho"))


def leverage_lag1(returns: DataFrame) -> DataFrame:
    """corr(x_t, |x_{t+1}|)."""
    out = returns.withColumn("y", F.abs(F.lead(X).over(_by()))).where("y is not null")
    return out.groupBy("ticker").agg(F.corr(X, "y").alias("rho"))


def newey_west(returns: DataFrame, bandwidth: int | None = None) -> DataFrame:
    """Long-run variance with Bartlett weights, floored at 0; bandwidth max(1, floor(cbrt n)) unless given."""
    held = returns.groupBy("ticker").agg(F.avg(X).alias("m"), F.count(X).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(X).alias("v")))), lambda s: s["v"]).alias("v"))
    h = F.lit(bandwidth) if bandwidth else F.greatest(F.lit(1), F.floor(F.cbrt("n")))
    held = held.withColumn("d", F.expr("transform(v, x -> x - m)")).withColumn("h", h.cast("int"))
    gamma = "aggregate(zip_with(slice(d, 1, size(d) - k), slice(d, k + 1, size(d) - k), (a, b) -> a * b), 0D, (s, x) -> s + x) / n"
    zero = "aggregate(d, 0D, (s, x) -> s + x * x) / n"
    lrv = F.expr(f"greatest(0D, {zero} + 2 * aggregate(transform(sequence(1, h), k -> (1D - k / cast(h + 1 as double)) * {gamma}), 0D, (s, x) -> s + x))")
    return held.select("ticker", "n", "h", F.col("m").alias("mean"), lrv.alias("lrv"), (F.col("m") / F.nullif(F.sqrt(lrv / F.col("n")), F.lit(0.0))).alias("z"))


def lag1_pearson(returns: DataFrame) -> DataFrame:
    """Correlation of consecutive values and of their sizes: each side by its own mean, unlike an autocorrelation."""
    rows = returns.withColumn("y", F.lead(X).over(_by()))
    return rows.groupBy("ticker").agg(F.count("y").alias("n"), F.corr(X, "y").alias("rho"), F.corr(F.abs(X), F.abs("y")).alias("rho_abs"))


def window_features(returns: DataFrame, w: int = 20) -> DataFrame:
    """Ten features of every window of w consecutive returns: mean, sd, skewness and excess kurtosis by that sd, maximum, minimum,
    range of the cumulative sum, and the correlations of x at lag 1 and of |x| at lags 1 and 5."""
    frame, x = _by().rowsBetween(0, w - 1), F.col(X)
    d = returns.select("ticker", "idx", X, F.lead(X).over(_by()).alias("y"), F.lead(X, 5).over(_by()).alias("y5"), F.sum(X).over(_by().rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    pairs, far = _by().rowsBetween(0, w - 2), _by().rowsBetween(0, w - 6)
    m1, m2, m3, m4 = (F.avg(x**k).over(frame) for k in (1, 2, 3, 4))
    sd = F.stddev_samp(X).over(frame) + 1e-12
    out = d.select(
        "ticker", "idx", F.count("*").over(frame).alias("n"), m1.alias("mean"), sd.alias("sd"),
        ((m3 - 3 * m1 * m2 + 2 * m1**3) / sd**3).alias("skew"), ((m4 - 4 * m1 * m3 + 6 * m1**2 * m2 - 3 * m1**4) / sd**4 - 3).alias("kurt"),
        F.max(X).over(frame).alias("hi"), F.min(X).over(frame).alias("lo"), (F.max("cum").over(frame) - F.min("cum").over(frame)).alias("cum_range"),
        F.corr(X, "y").over(pairs).alias("ac1"), F.corr(F.abs(X), F.abs("y")).over(pairs).alias("ac1_abs"), F.corr(F.abs(X), F.abs("y5")).over(far).alias("ac5_abs"),
    )
    return out.where(F.col("n") == w).drop("n")
