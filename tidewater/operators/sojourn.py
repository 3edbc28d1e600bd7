"""Lengths of stay in a state: negative binomial and truncated Pareto, and which of them is likelier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.special import lgamma
from tidewater.operators.stats import sojourn_moments


def sojourn_families(runs: DataFrame) -> DataFrame:
    """(ticker, state, n_runs, nb_r, nb_p, pareto_alpha, d_min, d_max, ll_nb, ll_pareto, family) from runs (ticker, state, length).

    Parameters as in sojourn_moments. Lengths are told apart by value and count first, so likelihoods cost a term for each
    distinct length. A state with fewer than three runs takes the negative binomial, as do ties.
    """
    fits = sojourn_moments(runs).join(runs.groupBy("ticker", "state").agg(F.min("length").alias("d_min")), ["ticker", "state"])
    fits = fits.withColumn("ln_z", F.expr("ln(aggregate(sequence(d_min, d_max), 0D, (s, d) -> s + pow(cast(d as double), -pareto_alpha - 1)))"))
    seen = runs.groupBy("ticker", "state", "length").agg(F.count("*").alias("times")).join(fits, ["ticker", "state"])
    k = "cast(greatest(length, 1) as double)"
    wide = f"{lgamma(f'({k} + nb_r)')} - {lgamma('nb_r')} - {lgamma(f'({k} + 1D)')} + nb_r * ln(nb_p) + {k} * ln(1D - nb_p)"
    nb = F.expr(f"if(nb_r is null, {k} * if(nb_p < 1D, ln(1D - nb_p), double('-Infinity')) + ln(nb_p), {wide})")
    pareto = F.expr("(-pareto_alpha - 1) * ln(length) - ln_z")
    sums = seen.groupBy("ticker", "state").agg(F.sum(F.col("times") * nb).alias("ll_nb"), F.sum(F.col("times") * pareto).alias("ll_pareto"))
    got = fits.drop("ln_z", "mean_len", "var_len").join(sums, ["ticker", "state"])
    heavy = (F.col("n_runs") >= 3) & (F.col("ll_pareto") > F.col("ll_nb"))
    return got.withColumn("family", F.when(heavy, "pareto").otherwise("nb"))


def pareto_table(fits: DataFrame) -> DataFrame:
    """(ticker, state, d, pmf, cdf, mean) of the truncated Pareto on d_min to d_max, pmf in proportion to d^(-alpha - 1)."""
    rows = fits.select("ticker", "state", "pareto_alpha", F.explode(F.sequence(F.col("d_min"), F.col("d_max"))).alias("d"))
    whole = Window.partitionBy("ticker", "state")
    rows = rows.withColumn("w", F.pow(F.col("d").cast("double"), -F.col("pareto_alpha") - 1)).withColumn("pmf", F.col("w") / F.sum("w").over(whole))
    return rows.select("ticker", "state", "d", "pmf", F.sum("pmf").over(whole.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("cdf"), F.sum(F.col("d") * F.col("pmf")).over(whole).alias("mean"))
