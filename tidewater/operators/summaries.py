"""Rollups of scores, spreads of samples and paths, and tables drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.special import lgamma


def group_rollup(scores: DataFrame, groups: DataFrame, limit: float, score: str = "score", worst_is_least: bool = True) -> DataFrame:
    """Per group of a dimension (ticker, grp): members, median, the worst member, members beyond the limit and their share.

    The worst member is the smallest and failures are below the limit, or the other way round.
    """
    rows = scores.join(groups, "ticker")
    failed = F.count_if(F.col(score) < limit if worst_is_least else F.col(score) > limit)
    by, of = (F.min_by, F.min) if worst_is_least else (F.max_by, F.max)
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.median(score).alias("median"), by("ticker", F.struct(score, "ticker")).alias("worst"), of(score).alias("worst_score"), failed.alias("failures"), (failed / F.count("*")).alias("failure_rate"))


def five_stats(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Median, quartiles as the sorted value at round-half-even(q (n + 1)), mean and sd; a key's values are ranked, not gathered."""
    whole = Window.partitionBy(key)
    held = rows.where(F.col(x).isNotNull()).select(key, x, F.row_number().over(whole.orderBy(x)).alias("r"), F.count("*").over(whole).alias("n"))
    at = lambda q: F.max(F.when(F.col("r") == F.greatest(F.lit(1), F.least("n", F.bround(q * (F.col("n") + 1)))), F.col(x)))
    return held.groupBy(key).agg(F.first("n").alias("n"), F.median(x).alias("median"), at(0.25).alias("q1"), at(0.75).alias("q3"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def across(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Mean and sd of x over the folds of a key."""
    return rows.groupBy(key).agg(F.count("*").alias("folds"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def band(rows: DataFrame, *key: str, x: str, probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Mean and interpolated quantiles of x, as columns q05 and so on."""
    cols = [F.element_at("q", i + 1).alias(f"q{round(100 * p):02d}") for i, p in enumerate(probs)]
    return rows.groupBy(*key).agg(F.avg(x).alias("mean"), F.percentile(x, F.array(*map(F.lit, probs))).alias("q")).select(*key, "mean", *cols)


def matrix_distance(a: DataFrame, b: DataFrame, key: list[str], cell: list[str], value: str = "p") -> DataFrame:
    """Frobenius norm of the difference of matrices in long form; a cell that one side lacks counts as 0."""
    both = a.select(*key, *cell, F.col(value).alias("x")).join(b.select(*key, *cell, F.col(value).alias("y")), [*key, *cell], "full")
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return both.groupBy(*key).agg(F.sqrt(F.sum(d * d)).alias("frobenius"), F.avg(F.abs(d)).alias("mean_abs"))


def information_criteria(fits: DataFrame, states: int) -> DataFrame:
    """AIC, BIC, HQC and CAIC of a Gaussian model of K states from (ll, n): K (K - 1) + 2 K parameters."""
    p, ll, n = F.lit(float(states * (states - 1) + 2 * states)), F.col("ll"), F.col("n")
    return fits.select("ticker", "n", (-2 * ll + 2 * p).alias("aic"), (-2 * ll + p * F.log(n)).alias("bic"), (-2 * ll + 2 * p * F.log(F.log(n))).alias("hqc"), (-2 * ll + p * (F.log(n) + 1)).alias("caic"))


def acf_error(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """Mean of the paths' mean absolute errors of autocorrelations, and the error of the paths' mean; both: ticker, lag, rho."""
    rows = paths.join(observed.select("ticker", "lag", F.col("rho").alias("y")), ["ticker", "lag"])
    each = rows.groupBy("ticker", "path").agg(F.avg(F.abs(F.col("rho") - F.col("y"))).alias("e")).groupBy("ticker").agg(F.avg("e").alias("mean_of_mae"))
    mean = rows.groupBy("ticker", "lag").agg(F.avg("rho").alias("rho"), F.first("y").alias("y")).groupBy("ticker").agg(F.avg(F.abs(F.col("rho") - F.col("y"))).alias("mae_of_mean"))
    return each.join(mean, "ticker")


def laplace_quantile(p: Column, location: Column, scale: Column) -> Column:
    return location - scale * F.signum(p - 0.5) * F.log(1 - 2 * F.abs(p - 0.5))


def laplace_qq(returns: DataFrame, fits: DataFrame) -> DataFrame:
    """(ticker, i, p, theoretical, sample): sorted values against the fitted Laplace quantiles at (i - 1/2) / n."""
    w = Window.partitionBy("ticker")
    rows = returns.withColumn("i", F.row_number().over(w.orderBy("g", "idx"))).withColumn("p", (F.col("i") - 0.5) / F.count("*").over(w))
    return rows.join(fits, "ticker").select("ticker", "i", "p", laplace_quantile(F.col("p"), F.col("location"), F.col("scale")).alias("theoretical"), F.col("g").alias("sample"))


def leverage_asymmetry(returns: DataFrame) -> DataFrame:
    """Mean |next value| after falls less that after rises; 0 for a side without rows."""
    rows = returns.withColumn("next", F.lead(F.abs("g")).over(Window.partitionBy("ticker").orderBy("idx"))).where("next is not null")
    side = lambda c: F.coalesce(F.avg(F.when(c, F.col("next"))), F.lit(0.0))
    return rows.groupBy("ticker").agg(side(F.col("g") < 0).alias("after_falls"), side(F.col("g") >= 0).alias("after_rises")).withColumn("asymmetry", F.col("after_falls") - F.col("after_rises"))


def vol_target(rows: DataFrame, target: float = 0.15, least: float = 0.1, most: float = 3.0) -> DataFrame:
    """Weights target / sqrt(variance) kept in [least, most] on rows (ticker, idx, g, variance): Sharpe ratio, return, risk, drawdown and turnover."""
    w = Window.partitionBy("ticker").orderBy("idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    weight = F.least(F.lit(most), F.greatest(F.lit(least), F.lit(target) / F.sqrt(F.greatest(F.col("variance"), F.lit(1e-10)))))
    rows = rows.withColumn("w", weight).withColumn("pnl", F.col("w") * F.col("g") / 252)
    rows = rows.withColumn("eq", F.sum("pnl").over(upto)).withColumn("turn", F.abs(F.col("w") - F.lag("w").over(w)))
    rows = rows.withColumn("fall", F.max("eq").over(upto) - F.col("eq"))
    out = rows.groupBy("ticker").agg((F.avg("pnl") * 252).alias("ann_ret"), (F.stddev_samp("pnl") * F.sqrt(F.lit(252.0))).alias("ann_vol"), F.max("fall").alias("mdd"), (F.sum("turn") * 252 / F.count("*")).alias("turnover"), F.avg("w").alias("mean_w"))
    return out.withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("ann_ret") / F.col("ann_vol")).otherwise(0.0))


def dominant_share(rows: DataFrame, key: str, x: str) -> DataFrame:
    """The share of a key's largest |x| in their sum, how many of the largest reach 95 and 99 %, and how many have over 1 %."""
    all_ = Window.partitionBy(key)
    upto = all_.orderBy(F.desc(F.abs(x)), "member").rowsBetween(Window.unboundedPreceding, 0)
    total = F.nullif(F.sum(F.abs(x)).over(all_), F.lit(0.0))
    part = rows.withColumn("cum", F.sum(F.abs(x)).over(upto) / total).withColumn("top", F.abs(x) / total)
    reach = lambda share: F.least(F.count("*"), F.count_if(F.col("cum") < share) + 1)
    return part.groupBy(key).agg(F.count("*").alias("n"), F.max("top").alias("top_share"), reach(0.95).alias("n_for_95"), reach(0.99).alias("n_for_99"), F.count_if(F.col("top") > 0.01).alias("n_above_1pct"))


def correlation_gaps(observed: DataFrame, paths: DataFrame) -> DataFrame:
    """Over paths (ticker, path_id, t, g): mean and deviation of the Frobenius distance of their correlations to the observed (a, b, rho), and the mean error off the diagonal."""
    a = paths.select("path_id", "t", F.col("ticker").alias("a"), F.col("g").alias("x"))
    both = a.join(paths.select("path_id", "t", F.col("ticker").alias("b"), F.col("g").alias("y")), ["path_id", "t"]).where("a < b")
    made = both.groupBy("path_id", "a", "b").agg(F.corr("x", "y").alias("made")).join(observed.select("a", "b", "rho"), ["a", "b"])
    gap = F.col("made") - F.col("rho")
    each = made.groupBy("path_id").agg(F.sqrt(2 * F.sum(gap * gap)).alias("f"), F.avg(F.abs(gap)).alias("m"))
    return each.agg(F.count("*").alias("paths"), F.avg("f").alias("frobenius_mean"), F.stddev_samp("f").alias("frobenius_sd"), F.avg("m").alias("mae"))


def binomial_two_sided(counts: DataFrame, p: float) -> DataFrame:
    """Exact two-sided test of x breaches in n: the probability of all counts that are at most as likely."""
    choose = f"{lgamma('(n + 1D)')} - {lgamma('(j + 1D)')} - {lgamma('(n - j + 1D)')}"
    pmf = f"transform(sequence(0, n), j -> exp({choose} + j * ln({p}D) + (n - j) * ln(1 - {p}D)))"
    held = counts.withColumn("n", F.col("n").cast("int")).withColumn("pmf", F.expr(pmf))
    total = "least(1D, aggregate(filter(pmf, q -> q <= pmf[cast(x as int)] + 1e-10D), 0D, (s, q) -> s + q))"
    return held.withColumn("p_exact", F.expr(total)).drop("pmf")
