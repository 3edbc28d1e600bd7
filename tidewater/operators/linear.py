"""Small linear systems in expressions: sums of products, solved by elimination folded over an array; no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_equations(rows: DataFrame, key: list[str], features: list[Column], y: Column) -> DataFrame:
    """key, n, yy and `system`: the rows of [X'X | X'y] over the rows where nothing is null."""
    names = [f"x{i}" for i in range(len(features))]
    rows = rows.select(*key, *[f.cast("double").alias(n) for f, n in zip(features, names, strict=True)], y.cast("double").alias("y")).dropna(subset=[*names, "y"])
    cell = {(a, b): f"{a}_{b}" for i, a in enumerate(names) for b in [*names[i:], "y"]}
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *(F.sum(F.col(a) * F.col(b)).alias(c) for (a, b), c in cell.items()))
    system = F.array(*[F.array(*[F.col(cell.get((a, b)) or cell[b, a]) for b in names], F.col(cell[a, "y"])) for a in names])
    return sums.select(*key, "n", "yy", system.alias("system"))


def solved(system: str, size: int) -> str:
    """SQL of the solution of [A | b], A symmetric and positive: array of `size` numbers, null where A is singular.

    Rows and columns are scaled to a unit diagonal, then each pivot row is taken from all others.
    """
    scale = f"transform(sequence(0, {size - 1}), k -> 1D / nullif(sqrt({system}[k][k]), 0D))"
    unit = f"transform({system}, (row, i) -> transform(row, (v, j) -> v * d[i] * if(j < {size}, d[least(j, {size - 1})], 1D)))"
    pivot = "transform(m, (row, i) -> if(i = k, row, zip_with(row, m[k], (a, b) -> a - b * row[k] / nullif(m[k][k], 0D))))"
    done = f"aggregate(sequence(0, {size - 1}), {unit}, (m, k) -> {pivot}, m -> transform(m, (row, i) -> row[{size}] / nullif(row[i], 0D) * d[i]))"
    return f"element_at(transform(array({scale}), d -> {done}), 1)"


def least_squares(rows: DataFrame, key: list[str], features: list[Column], y: Column) -> DataFrame:
    """key, n, yy, `beta` and `moments`: the coefficients of y on the features and X'y."""
    size = len(features)
    held = normal_equations(rows, key, features, y)
    return held.select(*key, "n", "yy", F.expr(solved("system", size)).alias("beta"), F.transform("system", lambda r: r[size]).alias("moments"))


def har_levels(rows: DataFrame, key: str = "ticker", x: str = "g") -> DataFrame:
    """(key, idx, rv, rv_d, rv_w, rv_m): squared value, that of the step before, and means over 5 and 22 steps before, from the 23rd."""
    by = Window.partitionBy(key).orderBy("idx")
    v = F.col(x) ** 2
    out = rows.select(key, "idx", v.alias("rv"), F.lag(v).over(by).alias("rv_d"), F.avg(v).over(by.rowsBetween(-5, -1)).alias("rv_w"), F.avg(v).over(by.rowsBetween(-22, -1)).alias("rv_m"), F.row_number().over(by).alias("step"))
    return out.where("step > 22").drop("step")


def har_coefficients(features: DataFrame, key: str = "ticker") -> DataFrame:
    return least_squares(features, [key], [F.lit(1.0), F.col("rv_d"), F.col("rv_w"), F.col("rv_m")], F.col("rv"))


def har_scores(features: DataFrame, fits: DataFrame, key: str = "ticker", floor: float = 1e-10) -> DataFrame:
    """(key, n, rmse, qlike) of forecasts, floored, of the features by the fits' coefficients."""
    rows = features.join(fits.select(key, "beta"), key)
    told = F.greatest(F.lit(floor), F.col("beta")[0] + F.col("beta")[1] * F.col("rv_d") + F.col("beta")[2] * F.col("rv_w") + F.col("beta")[3] * F.col("rv_m"))
    rows = rows.withColumn("told", told).withColumn("ratio", F.greatest(F.lit(floor), "rv") / F.col("told"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("told") - F.col("rv")) ** 2)).alias("rmse"), F.avg(F.col("ratio") - F.log("ratio") - 1).alias("qlike"))


def pooled_series(paths: DataFrame, n_paths: int, n_steps: int) -> DataFrame:
    """The first n_paths paths of a ticker as one series, one behind the other; windows reach over their seams."""
    return paths.where(F.col("path_id") <= n_paths).select("ticker", ((F.col("path_id") - 1) * n_steps + F.col("t")).alias("idx"), "g")


def chi2_tail_even(x: Column, dof: int) -> Column:
    """Upper tail of chi-squared with an even number of degrees of freedom."""
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, dof // 2):
        term = term * x / (2 * i)
        total = total + term
    return F.exp(-x / 2) * total


def dynamic_quantile(breaches: DataFrame, alpha: float) -> DataFrame:
    """Regression test of centred hits on a constant, their four lags and the VaR: (ticker, n, dq, p), chi-squared with 6."""
    by = Window.partitionBy("ticker").orderBy("idx")
    hits = breaches.withColumn("hit", F.col("breach").cast("double") - alpha)
    hits = hits.select("ticker", "var", "hit", *[F.lag("hit", k).over(by).alias(f"hit{k}") for k in range(1, 5)])
    fits = least_squares(hits, ["ticker"], [F.lit(1.0), *[F.col(f"hit{k}") for k in range(1, 5)], F.col("var")], F.col("hit"))
    dq = F.aggregate(F.zip_with("beta", "moments", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / (alpha * (1 - alpha))
    return fits.select("ticker", "n", dq.alias("dq")).withColumn("p", chi2_tail_even(F.col("dq"), 6))
