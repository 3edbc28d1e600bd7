"""Dependence between series, and the joins that line them up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned_pairs(returns: DataFrame) -> DataFrame:
    """(a, b, dt, x, y) of every pair of tickers on common dates."""
    a = returns.select("dt", F.col("ticker").alias("a"), F.col("g").alias("x"))
    return a.join(returns.select("dt", F.col("ticker").alias("b"), F.col("g").alias("y")), "dt").where("a < b")


def _inversions(y: np.ndarray) -> int:
    """Pairs i < j with y_i > y_j, by merging halves."""
    if len(y) < 2:
        return 0
    h = len(y) // 2
    a, b = y[:h], y[h:]
    n = _inversions(a) + _inversions(b)
    a, b = np.sort(a), np.sort(b)
    return n + int((len(a) - np.searchsorted(a, b, side="right")).sum())


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log^2 n."""
    n = len(x)
    pairs = n * (n - 1) // 2
    ties = lambda *v: int(sum(c * (c - 1) // 2 for c in np.unique(np.stack(v), axis=1, return_counts=True)[1]))
    tx, ty, both = ties(x), ties(y), ties(x, y)
    order = np.lexsort((y, x))
    apart = _inversions(y[order])
    score = pairs - tx - ty + both - 2 * apart
    bottom = np.sqrt(float(pairs - tx) * float(pairs - ty))
    return float(score / bottom) if bottom else float("nan")


def kendall_tau(returns: DataFrame) -> DataFrame:
    """(a, b, n, tau): one group per pair of tickers."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": [frame["a"].iloc[0]], "b": [frame["b"].iloc[0]], "n": [len(frame)], "tau": [tau_b(frame["x"].to_numpy(), frame["y"].to_numpy())]})

    return aligned_pairs(returns).groupBy("a", "b").applyInPandas(run, "a string, b string, n long, tau double")


def previous_value(rows: DataFrame, values: DataFrame, at: str, value: str, key: str = "ticker") -> DataFrame:
    """rows (key, at) with the key's last `value` strictly before each `at`: a shuffle by key and month, carried over the months of a key."""
    month = F.trunc(at, "month").alias("month")
    both = rows.select(key, at, month, F.lit(1).alias("side"), F.lit(None).cast("double").alias(value)).unionByName(values.select(key, at, month, F.lit(0).alias("side"), F.col(value).cast("double").alias(value)))
    # the side of the rows sorts first on one day, so that day's own value isn't seen
    within = Window.partitionBy(key, "month").orderBy(at, F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("found", F.last(value, ignorenulls=True).over(within))
    last = both.groupBy(key, "month").agg(F.max_by(value, F.when(F.col("side") == 0, F.col(at))).alias("last"))
    earlier = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "month", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    return seen.where("side = 1").join(carried, [key, "month"], "left").select(key, at, F.coalesce("found", "before").alias(value))


def vendor_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per series: relative price gaps and return gaps of two sources (series, dt, vwap) on common dates."""
    both = a.select("series", "dt", F.col("vwap").alias("x")).join(b.select("series", "dt", F.col("vwap").alias("y")), ["series", "dt"])
    w = Window.partitionBy("series").orderBy("dt")
    gap, step = (F.col("x") - F.col("y")) / F.col("y"), lambda c: F.log(F.col(c) / F.lag(c).over(w))
    out = both.withColumn("d", gap).withColumn("r", step("x") - step("y"))
    return out.groupBy("series").agg(F.count("*").alias("n"), F.avg("d").alias("mean_gap"), F.stddev_samp("d").alias("sd_gap"), F.max(F.abs("d")).alias("max_gap"), F.stddev_samp("r").alias("sd_return_gap"))


def nearest_correlation(tau: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Correlation matrix sin(pi tau / 2), its eigenvalues clipped from below and its diagonal set back to 1."""
    values, vectors = np.linalg.eigh(np.sin(np.pi * tau / 2))
    s = vectors * np.maximum(values, floor) @ vectors.T
    d = np.sqrt(np.diag(s))
    return s / np.outer(d, d)


def copula_log_likelihood(u: np.ndarray, sigma: np.ndarray, nu: float) -> float:
    """Log-likelihood of probability ranks under a t copula; nu = inf is the Gaussian one."""
    import math

    from tidewater.functions.dists import log_density, quantile

    family = "normal" if math.isinf(nu) else "t"
    levels, at = np.unique(u, return_inverse=True)
    q = np.array([quantile(family, float(p), nu) for p in levels])[at].reshape(u.shape)
    d = u.shape[1]
    form = np.einsum("ij,jk,ik->i", q, np.linalg.inv(sigma), q)
    half = -0.5 * np.linalg.slogdet(sigma)[1]
    if family == "normal":
        joint = half - 0.5 * form - d / 2 * math.log(2 * math.pi)
    else:
        joint = half + math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - d / 2 * math.log(math.pi * nu) - (nu + d) / 2 * np.log1p(form / nu)
    return float((joint - log_density(family, q, 0.0, 1.0, nu).sum(1)).sum())


def copula_profile(returns: DataFrame, tickers: list[str], nus: list[float]) -> DataFrame:
    """(nu, n, ll, sigma) for each degree of freedom, one group each; 1e9 stands for the Gaussian copula.

    Series are aligned on common dates; the correlation comes from Kendall's tau.
    """
    wide = returns.groupBy("dt").pivot("ticker", tickers).agg(F.first("g")).dropna()
    grid = wide.withColumn("nu", F.explode(F.array(*[F.lit(float(v)) for v in nus])))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("dt")[tickers].to_numpy()
        d, nu = len(tickers), float(frame["nu"].iloc[0])
        tau = np.eye(d)
        for i in range(d):
            for j in range(i):
                tau[i, j] = tau[j, i] = tau_b(x[:, i], x[:, j])
        sigma = nearest_correlation(tau)
        u = (x.argsort(0, kind="stable").argsort(0) + 1) / (len(x) + 1)
        return pd.DataFrame([{"nu": nu, "n": len(x), "ll": copula_log_likelihood(u, sigma, np.inf if nu >= 1e9 else nu), "sigma": sigma.tolist()}])

    return grid.groupBy("nu").applyInPandas(run, "nu double, n long, ll double, sigma array<array<double>>")
