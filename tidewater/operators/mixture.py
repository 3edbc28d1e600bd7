"""Value at risk of mixtures of states: searched on a grid for every step, and from a decoded state's own distribution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = 2500


def grid_var(rows: DataFrame, weights: str, cdfs: list[Callable[[str], str]], lowest: float, highest: float, alpha: float, points: int = GRID) -> DataFrame:
    """rows with `var`: the first of `points` even points of [lowest, highest] at which the mixture's distribution reaches alpha, else the last.

    weights: SQL of the states' weights; cdfs: of each state's distribution function. The bracket of the first point is halved
    until it is found, for every row by itself.
    """
    at = lambda i: f"({lowest!r}D + ({i}) * {(highest - lowest) / (points - 1)!r}D)"
    total = lambda x: " + ".join(f"{weights}[{k}] * {f(x)}" for k, f in enumerate(cdfs))
    middle = "cast((s.lo + s.hi) div 2 as int)"
    step = f"element_at(transform(array(if(s.lo < s.hi, {total(at(middle))}, 0D)), c -> named_struct('lo', if(s.lo < s.hi and c < {alpha!r}D, {middle} + 1, s.lo), 'hi', if(s.lo < s.hi and c >= {alpha!r}D, {middle}, s.hi))), 1)"
    found = f"aggregate(sequence(1, {points.bit_length()}), named_struct('lo', 0, 'hi', {points - 1}), (s, i) -> {step}, s -> s.lo)"
    return rows.withColumn("var", F.expr(at(found)))


def decoded_state_var(binned: DataFrame, quantile: float, state: str = "bin") -> DataFrame:
    """(ticker, idx, g, state, var_step, var_still): quantiles of the decoded state's autoregression, from the step before and from its still distribution.

    A state has its mean, slope (clamped to 0.999, 0 without pairs) and residual deviation over consecutive steps within it;
    the first step stands at its state's mean.
    """
    by = Window.partitionBy("ticker").orderBy("idx")
    rows = binned.select("ticker", "idx", "g", F.col(state).alias("state"), F.lag("g").over(by).alias("before"), F.lag(state).over(by).alias("was"))
    means = rows.groupBy("ticker", "state").agg(F.avg("g").alias("mu"), F.stddev_samp("g").alias("sd"))
    within = F.col("was") == F.col("state")
    slope = F.least(F.lit(0.999), F.greatest(F.lit(-0.999), F.regr_slope(F.when(within, F.col("g")), F.when(within, F.col("before")))))
    slopes = rows.groupBy("ticker", "state").agg(F.coalesce(slope, F.lit(0.0)).alias("phi"))
    held = rows.join(means.join(slopes, ["ticker", "state"]), ["ticker", "state"])
    left = (F.col("g") - F.col("mu")) - F.col("phi") * (F.col("before") - F.col("mu"))
    scale = held.groupBy("ticker", "state").agg(F.coalesce(F.stddev_samp(F.when(within, left)), F.first("sd")).alias("sigma"))
    held = held.join(scale, ["ticker", "state"])
    step = F.col("mu") + F.col("phi") * (F.coalesce("before", "mu") - F.col("mu")) + F.col("sigma") * quantile
    still = F.col("mu") + F.col("sigma") / F.sqrt(F.greatest(1 - F.col("phi") ** 2, F.lit(1e-6))) * quantile
    return held.select("ticker", "idx", "g", "state", step.alias("var_step"), still.alias("var_still"))
