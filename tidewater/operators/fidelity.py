"""Distances between samples and scores of simulated paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ks_distance(rows: DataFrame, *key: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key. rows: key, side (0 or 1), x."""
    all_ = Window.partitionBy(*key)
    upto = all_.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    share = lambda s: F.sum((F.col("side") == s).cast("int")).over(upto) / F.nullif(F.sum((F.col("side") == s).cast("int")).over(all_), F.lit(0))
    out = rows.withColumn("gap", F.abs(share(0) - share(1)))
    return out.groupBy(*key).agg(F.max("gap").alias("ks"), F.sum((F.col("side") == 0).cast("int")).alias("n"), F.sum((F.col("side") == 1).cast("int")).alias("m"))


def ks_p_value(ks: Column, n: Column, m: Column) -> Column:
    """Kolmogorov's asymptotic p-value, 100 terms; 1 near no distance, where it is 1 to 1e-12 and the terms don't settle."""
    lam2 = ks * ks * n * m / (n + m)
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam2))
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))
    return F.when(lam2 < 0.04, 1.0).otherwise(total)


def ticker_pairs(returns: DataFrame, x: str = "g") -> DataFrame:
    """Every pair a < b of tickers with both samples: (a, b, side, x)."""
    names = returns.select("ticker").distinct()
    pairs = names.select(F.col("ticker").alias("a")).join(names.select(F.col("ticker").alias("b")), F.col("a") < F.col("b"))
    left = pairs.join(returns.select(F.col("ticker").alias("a"), F.col(x).alias("x")), "a").select("a", "b", F.lit(0).alias("side"), "x")
    return left.unionByName(pairs.join(returns.select(F.col("ticker").alias("b"), F.col(x).alias("x")), "b").select("a", "b", F.lit(1).alias("side"), "x"))


def wasserstein1(rows: DataFrame, *key: str) -> DataFrame:
    """Mean gap of sorted samples, the longer one subsampled at round-half-even(k n / n_min)."""
    w = Window.partitionBy(*key, "side")
    ranked = rows.select(*key, "side", "x", F.row_number().over(w.orderBy("x")).alias("r"), F.count("*").over(w).alias("n"))
    sizes = ranked.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("n0"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n1"))
    steps = sizes.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n0", "n1"))))
    at = lambda n: F.bround(F.col("k") * F.col(n) / F.least("n0", "n1")).cast("long")
    one = ranked.where("side = 0").select(*key, F.col("r").alias("r0"), F.col("x").alias("x0"))
    two = ranked.where("side = 1").select(*key, F.col("r").alias("r1"), F.col("x").alias("x1"))
    met = steps.withColumn("r0", at("n0")).withColumn("r1", at("n1")).join(one, [*key, "r0"]).join(two, [*key, "r1"])
    return met.groupBy(*key).agg(F.avg(F.abs(F.col("x0") - F.col("x1"))).alias("w1"))


def hellinger(rows: DataFrame, *key: str, bins: int = 100, pad: float = 10.0) -> DataFrame:
    """Hellinger distance of histograms over `bins` equal bins of [min - pad, max + pad]."""
    w = Window.partitionBy(*key)
    lo, hi = F.min("x").over(w) - pad, F.max("x").over(w) + pad
    bucket = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    counts = rows.withColumn("bucket", bucket).groupBy(*key, "bucket").agg(F.sum((F.col("side") == 0).cast("int")).alias("p"), F.sum((F.col("side") == 1).cast("int")).alias("q"))
    shares = counts.withColumn("d", (F.sqrt(F.col("p") / F.sum("p").over(w)) - F.sqrt(F.col("q") / F.sum("q").over(w))) ** 2)
    return shares.groupBy(*key).agg(F.sqrt(F.sum("d") / 2).alias("hellinger"))


def crps(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """Unbiased ensemble CRPS per step: paths (ticker, t, path_id, g), observed (ticker, t, y)."""
    w = Window.partitionBy("ticker", "t")
    rows = paths.join(observed, ["ticker", "t"]).withColumn("i", F.row_number().over(w.orderBy("g", "path_id"))).withColumn("n", F.count("*").over(w))
    spread = F.sum(F.col("g") * (2 * F.col("i") - F.col("n") - 1)) / (F.first("n") * (F.first("n") - 1))
    return rows.groupBy("ticker", "t").agg((F.avg(F.abs(F.col("g") - F.col("y"))) - spread).alias("crps"))


def auc(rows: DataFrame, score: str, positive: str, ranges: int = 1024) -> DataFrame:
    """Area under the ROC curve by average ranks of ties: counts by score, then running sums within even ranges of scores and over the ranges."""
    by = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    ends = by.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    by = by.join(F.broadcast(ends)).withColumn("range", F.when(F.col("high") > F.col("low"), F.least(F.lit(ranges - 1), F.floor((F.col("s") - F.col("low")) / (F.col("high") - F.col("low")) * ranges))).otherwise(0))  # one row
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over `ranges` rows at most
    before = by.groupBy("range").agg(F.sum("n").alias("held")).select("range", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"))
    inner = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(before, "range").withColumn("rank", F.col("before") + F.col("inner") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auc"))
