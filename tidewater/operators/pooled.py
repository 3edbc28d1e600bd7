"""Paths against the observed series, by the running counts of their pooled distinct values.

Every distinct observed value has a term of its own in a path's rank statistics, so a path's rows are its own distinct values
and the observed ones, with counts, dealt out by path: as many rows as terms, and none is sorted by anything but its path.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.fidelity import ks_p_value
from tidewater.operators.stats import autocorrelations, path_autocorrelations, sample_excess_kurtosis
from tidewater.operators.summaries import acf_error

#: Published quantile coefficients of the standardised statistic, by upper tail probability: fixed values.
_TAILS = (0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)
_B0 = (0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085)
_B1 = (-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615)
_B2 = (-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154)


def pooled_counts(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """(ticker, path_id, x, p, q, p_upto, q_upto, n, m): how often a path (p) and its ticker's series (q) have each value, and at most it."""
    own = paths.groupBy("ticker", "path_id", F.col("g").alias("x")).agg(F.count("*").alias("p")).withColumn("q", F.lit(0).cast("long"))
    seen = observed.groupBy("ticker", F.col("g").alias("x")).agg(F.count("*").alias("q")).withColumn("p", F.lit(0).cast("long"))
    ids = paths.select("ticker", "path_id").distinct()
    both = own.unionByName(ids.join(seen, "ticker")).repartition("ticker", "path_id")  # the grouping and the windows keep this
    counts = both.groupBy("ticker", "path_id", "x").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    whole = Window.partitionBy("ticker", "path_id")
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("*", F.sum("p").over(upto).alias("p_upto"), F.sum("q").over(upto).alias("q_upto"), F.sum("p").over(whole).alias("n"), F.sum("q").over(whole).alias("m"))


def rank_statistics(counts: DataFrame) -> DataFrame:
    """(ticker, path_id, n, m, ks, a2): Kolmogorov-Smirnov distance and the two-sample Anderson-Darling statistic with midranks of ties.

    a2 is null where all values are equal.
    """
    total, here = F.col("n") + F.col("m"), F.col("p") + F.col("q")
    b = F.col("p_upto") + F.col("q_upto") - here / 2
    gap = total * (F.col("p_upto") - F.col("p") / 2) - F.col("n") * b
    term = here / total * gap * gap / F.nullif(b * (total - b) - total * here / 4, F.lit(0.0))
    got = counts.groupBy("ticker", "path_id").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max(F.abs(F.col("p_upto") / F.col("n") - F.col("q_upto") / F.col("m"))).alias("ks"), F.sum(term).alias("s"))
    return got.select("ticker", "path_id", "n", "m", "ks", ((total - 1) / total * (1 / F.col("n") + 1 / F.col("m")) * F.col("s")).alias("a2"))


def _variance(n: Column, m: Column) -> Column:
    """Variance of the statistic of two samples without ties."""
    total = (n + m).cast("long")
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), total - 1), F.lit(0.0), lambda s, i: s + 1 / i)
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("g"))
    g = F.aggregate(F.sequence(F.lit(1).cast("long"), total - 2), start, lambda s, i: F.struct((s["h"] + 1 / i).alias("h"), (s["g"] + (harmonic - s["h"] - 1 / i) / (total - i)).alias("g")), lambda s: s["g"])
    both = 1 / n + 1 / m
    h, t, k = F.col("harmonic"), total.cast("double"), 2
    a = (4 * F.col("g") - 6) * (k - 1) + (10 - 6 * F.col("g")) * both
    b = (2 * F.col("g") - 4) * k**2 + 8 * h * k + (2 * F.col("g") - 14 * h - 4) * both - 8 * h + 4 * F.col("g") - 6
    c = (6 * h + 2 * F.col("g") - 2) * k**2 + (4 * h - 4 * F.col("g") + 6) * k + (2 * h - 6) * both + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    return harmonic, g, (a * t**3 + b * t**2 + c * t + d) / ((t - 1) * (t - 2) * (t - 3))


def tail_fit() -> list[float]:
    """Coefficients, from the square down, of ln p as a square polynomial of the standardised statistic of two samples."""
    return np.polyfit(np.array(_B0) + np.array(_B1) + np.array(_B2), np.log(_TAILS), 2).tolist()


def anderson_darling(statistics: DataFrame) -> DataFrame:
    """statistics with z, the standardised statistic, and p, its upper tail probability within the table's 0.001 to 0.25."""
    sizes = statistics.select("n", "m").distinct()
    harmonic, g, variance = _variance(F.col("n"), F.col("m"))
    sizes = sizes.withColumn("harmonic", harmonic).withColumn("g", g.cast("double")).withColumn("variance", variance).select("n", "m", "variance")
    c2, c1, c0 = tail_fit()
    p = F.exp(c2 * F.col("z") ** 2 + c1 * F.col("z") + c0)
    least = np.array(_B0) + np.array(_B1) + np.array(_B2)
    p = F.when(F.col("z") <= float(least[0]), _TAILS[0]).when(F.col("z") >= float(least[-1]), _TAILS[-1]).otherwise(p)
    return statistics.join(sizes, ["n", "m"]).withColumn("z", (F.col("a2") - 1) / F.sqrt("variance")).withColumn("p", F.when(F.col("z").isNotNull(), p)).drop("variance")


def wasserstein(counts: DataFrame, observed: DataFrame) -> DataFrame:
    """(ticker, path_id, w1): mean gap of sorted values, the longer sample taken at round-half-even(k n / n_min).

    A path's ranks come from its pooled counts; the observed series is ranked once for all paths.
    """
    ranked = observed.select("ticker", F.col("g").alias("y"), F.row_number().over(Window.partitionBy("ticker").orderBy("g", "idx")).cast("long").alias("r"))
    least = F.least("n", "m")
    lo, hi = F.col("p_upto") - F.col("p") + 1, F.col("p_upto")
    first = F.greatest(F.lit(1).cast("long"), F.ceil((lo - 0.5) * least / F.col("n")))
    last = F.least(least, F.floor((hi + 0.5) * least / F.col("n")))
    rows = counts.where("p > 0").withColumns({"lo": lo, "hi": hi, "least": least, "first": first, "last": last}).where("first <= last")
    rows = rows.withColumn("k", F.explode(F.sequence("first", "last"))).where(F.bround(F.col("k") * F.col("n") / F.col("least")).between(F.col("lo"), F.col("hi")))
    rows = rows.withColumn("r", F.bround(F.col("k") * F.col("m") / F.col("least")).cast("long"))
    return rows.join(ranked, ["ticker", "r"]).groupBy("ticker", "path_id").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("w1"))


def hellinger(counts: DataFrame, bins: int = 100, pad: float = 10.0) -> DataFrame:
    """(ticker, path_id, hellinger) of histograms over `bins` equal bins of each path's pooled range, widened by pad."""
    whole = Window.partitionBy("ticker", "path_id")
    rows = counts.withColumns({"low": F.min("x").over(whole) - pad, "high": F.max("x").over(whole) + pad})
    rows = rows.withColumn("bucket", F.least(F.floor((F.col("x") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1)))
    shares = rows.groupBy("ticker", "path_id", "bucket").agg((F.sum("p") / F.first("n")).alias("a"), (F.sum("q") / F.first("m")).alias("b"))
    return shares.groupBy("ticker", "path_id").agg(F.sqrt(F.sum((F.sqrt("a") - F.sqrt("b")) ** 2) / 2).alias("hellinger"))


def pass_rates(generators: list[tuple[str, DataFrame, DataFrame]], level: float = 0.05) -> DataFrame:
    """(ticker, generator, paths, mean_ks, pass_rate): share of each generator's paths with a Kolmogorov-Smirnov p-value over level."""
    found = []
    for name, paths, observed in generators:
        ranks = rank_statistics(pooled_counts(paths, observed))
        passed = (ks_p_value(F.col("ks"), F.col("n"), F.col("m")) > level).cast("double")
        found.append(ranks.groupBy("ticker").agg(F.count("*").alias("paths"), F.avg("ks").alias("mean_ks"), F.avg(passed).alias("pass_rate")).withColumn("generator", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def quantile_coverage(paths: DataFrame, observed: DataFrame, n: int = 99) -> DataFrame:
    """(ticker, coverage): share of n observed quantiles within the paths' own 5 % - 95 % band."""
    probs = F.array(*[F.lit(i / (n + 1)) for i in range(1, n + 1)])
    made = paths.groupBy("ticker", "path_id").agg(F.percentile("g", probs).alias("q")).select("ticker", F.posexplode("q").alias("i", "q"))
    band = made.groupBy("ticker", "i").agg(F.percentile("q", F.array(F.lit(0.05), F.lit(0.95))).alias("b"))
    seen = observed.groupBy("ticker").agg(F.percentile("g", probs).alias("q")).select("ticker", F.posexplode("q").alias("i", "y"))
    return band.join(seen, ["ticker", "i"]).groupBy("ticker").agg(F.avg(F.col("y").between(F.col("b")[0], F.col("b")[1]).cast("double")).alias("coverage"))


def path_panel(paths: DataFrame, observed: DataFrame, lags: int) -> DataFrame:
    """A row for each ticker: the seven scores of its paths. One pooled relation feeds both rank tests, the distance and the histograms."""
    counts = pooled_counts(paths, observed)
    ranks = anderson_darling(rank_statistics(counts)).withColumn("ks_p", ks_p_value(F.col("ks"), F.col("n"), F.col("m")))
    passed = lambda p: F.avg(F.coalesce(F.col(p) > 0.05, F.lit(False)).cast("double"))
    tests = ranks.groupBy("ticker").agg(F.count("*").alias("paths"), passed("ks_p").alias("ks_pass"), passed("p").alias("ad_pass"))
    w1 = wasserstein(counts, observed).groupBy("ticker").agg(F.avg("w1").alias("w1"))
    bins = hellinger(counts).groupBy("ticker").agg(F.avg("hellinger").alias("hellinger"))
    kurtosis = paths.groupBy("ticker", "path_id").agg(sample_excess_kurtosis().alias("k")).groupBy("ticker").agg(F.avg("k").alias("kurtosis"))
    acf = path_autocorrelations(paths.withColumn("g", F.abs("g")), lags)
    errors = acf_error(acf, autocorrelations(observed.withColumn("g", F.abs("g")), lags)).select("ticker", F.col("mean_of_mae").alias("acf_mae"))
    got = tests
    for part in (w1, bins, kurtosis, errors, quantile_coverage(paths, observed)):
        got = got.join(part, "ticker")
    return got
