"""Value at risk and its backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TINY = 1e-10


def var_es(returns: DataFrame, alpha: float, x: str = "g") -> DataFrame:
    """Interpolated alpha-quantile, and the mean of what is at or below it."""
    cut = returns.groupBy("ticker").agg(F.expr(f"percentile({x}, {alpha})").alias("var"))
    return returns.join(cut, "ticker").groupBy("ticker").agg(F.first("var").alias("var"), F.avg(F.when(F.col(x) <= F.col("var"), F.col(x))).alias("es"))


def rolling_breaches(returns: DataFrame, alpha: float, window: int, x: str = "g") -> DataFrame:
    """(ticker, idx, breach): below the alpha-quantile of the `window` returns before; from the first full window."""
    w = Window.partitionBy("ticker").orderBy("idx").rowsBetween(-window, -1)
    out = returns.withColumn("var", F.percentile(x, F.lit(alpha)).over(w))
    return out.where(F.col("idx") > window).select("ticker", "idx", "var", (F.col(x) < F.col("var")).alias("breach"))


def breach_counts(breaches: DataFrame, *key: str) -> DataFrame:
    """n, x (breaches), and the counts n00 .. n11 of consecutive pairs."""
    w = Window.partitionBy(*key).orderBy("idx")
    b = F.col("breach").cast("int")
    pairs = breaches.withColumn("before", F.lag(b).over(w)).withColumn("b", b)
    return pairs.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("b").alias("x"),
        *[F.sum(F.when((F.col("before") == i) & (F.col("b") == j), 1).otherwise(0)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)],
    )


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def kupiec(n: Column, x: Column, alpha: float) -> Column:
    """Unconditional coverage likelihood ratio; the rate is kept off 0 and 1."""
    p = F.least(F.lit(1 - _TINY), F.greatest(F.lit(_TINY), x / n))
    return -2 * ((n - x) * F.log(F.lit(1 - alpha)) + x * F.log(F.lit(alpha)) - (n - x) * F.log(1 - p) - x * F.log(p))


def christoffersen(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Independence likelihood ratio; 0 where a row of the counts is empty or no breach moves."""
    p01, p11 = n01 / F.nullif(n00 + n01, F.lit(0)), n11 / F.nullif(n10 + n11, F.lit(0))
    p = (n01 + n11) / F.nullif(n00 + n01 + n10 + n11, F.lit(0))
    alike = _xlogy(n00 + n10, 1 - p) + _xlogy(n01 + n11, p)
    apart = _xlogy(n00, 1 - p01) + _xlogy(n01, p01) + _xlogy(n10, 1 - p11) + _xlogy(n11, p11)
    fine = ((n00 + n01) > 0) & ((n10 + n11) > 0) & ((n01 + n11) > 0)
    return F.when(fine, F.greatest(F.lit(0.0), -2 * (alike - apart))).otherwise(0.0)


def chi2_1_tail(x: Column) -> Column:
    """P(chi-squared with one degree of freedom > x), erfc(sqrt(x / 2)) by a rational approximation good to 1.5e-7."""
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    t = 1 / (1 + 0.3275911 * z)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)


def coverage_tests(breaches: DataFrame, alpha: float, *key: str) -> DataFrame:
    """Breach counts with the coverage, independence and joint statistics and their p-values (chi-squared, 1, 1 and 2)."""
    out = breach_counts(breaches, *key)
    out = out.withColumn("lr_uc", kupiec(F.col("n"), F.col("x"), alpha)).withColumn("lr_ind", christoffersen(*(F.col(c) for c in ("n00", "n01", "n10", "n11"))))
    out = out.withColumn("p_uc", chi2_1_tail(F.col("lr_uc"))).withColumn("p_ind", chi2_1_tail(F.col("lr_ind")))
    return out.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind")).withColumn("p_cc", F.exp(-F.col("lr_cc") / 2))
