"""Comparisons of sources, models and samples: verdicts, envelopes, simulated p-values, matrices made from matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.special import let, lgamma


def common_dates(bars: DataFrame) -> DataFrame:
    """(dt) that every ticker has."""
    tickers = bars.select("ticker").distinct().agg(F.count("*").alias("tickers"))
    held = bars.select("ticker", "dt").distinct().groupBy("dt").agg(F.count("*").alias("n"))
    return held.join(F.broadcast(tickers)).where("n = tickers").select("dt")  # one row


def picked(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows on the given dates, numbered by date within their ticker, so that sources can be compared place by place."""
    rows = bars.join(dates, "dt", "left_semi")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("dt")))


def positional_pairs(returns: DataFrame) -> DataFrame:
    """(a, b, place, x, y) of every pair of tickers by place from the start, as far as the shorter goes; dates don't matter."""
    rows = returns.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("idx")))
    left = rows.select(F.col("ticker").alias("a"), "place", F.col("g").alias("x"))
    return left.join(rows.select(F.col("ticker").alias("b"), "place", F.col("g").alias("y")), "place").where("a < b")


def stitch_verdict(ks_p: Column, kurtosis_gap: Column, least_p: float = 0.01, most_gap: float = 1.5) -> list[Column]:
    """Verdict and notes on two sources that overlap: they fail where a rank test rejects, and are noted where rolling kurtosis parts."""
    rejected, apart = F.coalesce(ks_p < least_p, F.lit(False)), F.coalesce(kurtosis_gap > most_gap, F.lit(False))
    notes = F.array_compact(F.array(F.when(rejected, "distribution"), F.when(apart, "kurtosis")))
    return [F.when(rejected, "FAIL").otherwise("PASS").alias("verdict"), F.array_join(notes, ",").alias("notes")]


def envelope(rows: DataFrame, *key: str, x: str) -> DataFrame:
    """Median and the 5 % and 95 % quantiles of x, also as a report's cell."""
    q = rows.groupBy(*key).agg(F.percentile(x, F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q"))
    return q.select(*key, *[F.col("q")[i].alias(c) for i, c in enumerate(("median", "low", "high"))]).withColumn("cell", F.format_string("%.3f [%.3f, %.3f]", "median", "low", "high"))


def cell_numbers(cell: Column) -> list[Column]:
    """Median, low and high of a cell `median [low, high]`; null where it isn't one."""
    form = r"^\s*(\S+)\s*\[\s*([^,\s]+)\s*,\s*([^\]\s]+)\s*\]\s*$"
    return [F.regexp_extract(cell, form, i + 1).try_cast("double").alias(c) for i, c in enumerate(("median", "low", "high"))]


def simulated_p(observed: DataFrame, simulated: DataFrame, key: list[str], x: str) -> DataFrame:
    """Two-sided: the share of simulated statistics at least as far from their median as the observed one; 1 without any."""
    middle = simulated.groupBy(*key).agg(F.median(x).alias("middle"))
    rows = observed.select(*key, F.col(x).alias("seen")).join(middle, key, "left").join(simulated.select(*key, x), key, "left")
    return rows.groupBy(*key).agg(F.first("seen").alias("observed"), F.first("middle").alias("median"), F.coalesce(F.avg((F.abs(F.col(x) - F.col("middle")) >= F.abs(F.col("seen") - F.col("middle"))).cast("double")), F.lit(1.0)).alias("p"))


def jump_matrix(matrix: DataFrame) -> DataFrame:
    """(ticker, from_state, to_state, p): where a jump goes, the likelier the less likely a step there is: (1 - p) by its row's sum."""
    left = 1 - F.col("p")
    return matrix.select("ticker", "from_state", "to_state", (left / F.sum(left).over(Window.partitionBy("ticker", "from_state"))).alias("p"))


def emission_matrix(states: DataFrame, off: float = 0.001) -> DataFrame:
    """(state, symbol, p): 1 on the diagonal and `off` beside it, by the row's sum. states: state."""
    rows = states.select("state").join(states.select(F.col("state").alias("symbol")))
    weight = F.when(F.col("state") == F.col("symbol"), 1.0).otherwise(off)
    return rows.select("state", "symbol", (weight / F.sum(weight).over(Window.partitionBy("state"))).alias("p"))


def canonical_matrix(matrix: DataFrame, scales: DataFrame) -> DataFrame:
    """matrix with both axes renumbered by ascending scale. scales: ticker, state, scale; ties by state."""
    rank = scales.select("ticker", "state", F.row_number().over(Window.partitionBy("ticker").orderBy("scale", "state")).alias("rank"))
    rows = matrix.join(rank.withColumnsRenamed({"state": "from_state", "rank": "i"}), ["ticker", "from_state"]).join(rank.withColumnsRenamed({"state": "to_state", "rank": "j"}), ["ticker", "to_state"])
    return rows.select("ticker", F.col("i").alias("from_state"), F.col("j").alias("to_state"), "p")


def matrix_distances(matrix: DataFrame) -> DataFrame:
    """(a, b, frobenius) of every pair of tickers' matrices."""
    left = matrix.select(F.col("ticker").alias("a"), "from_state", "to_state", F.col("p").alias("x"))
    both = left.join(matrix.select(F.col("ticker").alias("b"), "from_state", "to_state", F.col("p").alias("y")), ["from_state", "to_state"]).where("a < b")
    return both.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("frobenius"))


def softmax(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """rows with `share`: exp(x) by the sum of its key, from the largest x."""
    w = Window.partitionBy(*key)
    e = F.exp(F.col(x) - F.max(x).over(w))
    return rows.withColumn("e", e).withColumn("share", F.col("e") / F.sum("e").over(w)).drop("e")


def ged_shapes(rows: DataFrame, *key: str, lowest: float = 0.5, step: float = 0.01, n: int = 251, x: str = "g") -> DataFrame:
    """(key, ratio, shape): the shape, on an even grid, whose ratio of mean size to deviation is closest to the centred sample's."""
    mean = rows.groupBy(*key).agg(F.avg(x).alias("mean"))
    d = rows.join(mean, list(key)).withColumn("d", F.col(x) - F.col("mean"))
    seen = d.groupBy(*key).agg((F.avg(F.abs("d")) / F.nullif(F.sqrt(F.avg(F.col("d") ** 2)), F.lit(0.0))).alias("ratio"))
    p = f"({lowest!r}D + i * {step!r}D)"
    ratio = let(p, "p", f"exp({lgamma('(2D / p)')} - 0.5D * ({lgamma('(1D / p)')} + {lgamma('(3D / p)')}))")
    grid = rows.sparkSession.range(n).selectExpr(f"transform(array(cast(id as int)), i -> {p})[0] as shape", f"transform(array(cast(id as int)), i -> {ratio})[0] as r")
    best = seen.join(F.broadcast(grid)).groupBy(*key, "ratio").agg(F.min_by("shape", F.struct(F.abs(F.col("r") - F.col("ratio")).alias("gap"), "shape")).alias("shape"))  # n rows of two numbers
    return best.select(*key, "ratio", "shape")


def shape_classes(shapes: DataFrame, *key: str) -> DataFrame:
    """How many shapes are near Gaussian (1.85 and more), between, near Laplace (0.85 to 1.3) and sharper."""
    s = F.col("shape")
    return shapes.groupBy(*key).agg(F.count_if(s >= 1.85).alias("gauss"), F.count_if((s >= 1.3) & (s < 1.85)).alias("between"), F.count_if((s >= 0.85) & (s < 1.3)).alias("laplace"), F.count_if(s < 0.85).alias("sharper"))


def pair_errors(observed: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, rho, made, error): observed correlations against the mean of the paths'. observed: a, b, rho; paths: ticker, path_id, t, g."""
    left = paths.select("path_id", "t", F.col("ticker").alias("a"), F.col("g").alias("x"))
    both = left.join(paths.select("path_id", "t", F.col("ticker").alias("b"), F.col("g").alias("y")), ["path_id", "t"]).where("a < b")
    made = both.groupBy("path_id", "a", "b").agg(F.corr("x", "y").alias("rho")).groupBy("a", "b").agg(F.avg("rho").alias("made"))
    return observed.join(made, ["a", "b"]).select("a", "b", "rho", "made", F.abs(F.col("made") - F.col("rho")).alias("error"))


def with_and_without(errors: DataFrame, asset: str) -> DataFrame:
    """Mean error of all pairs, of those without the asset, and of those with it."""
    has = (F.col("a") == asset) | (F.col("b") == asset)
    return errors.agg(F.avg("error").alias("all_pairs"), F.avg(F.when(~has, F.col("error"))).alias("without"), F.avg(F.when(has, F.col("error"))).alias("own_pairs"))


def tail_quantiles(observed: DataFrame, paths: DataFrame, n: int = 200, edge: float = 0.001) -> DataFrame:
    """(ticker, i, observed, simulated): quantiles at n even probabilities from edge to 1 - edge, the paths pooled."""
    probs = F.array(*[F.lit(edge + i * (1 - 2 * edge) / (n - 1)) for i in range(n)])
    a = observed.groupBy("ticker").agg(F.percentile("g", probs).alias("p"))
    b = paths.groupBy("ticker").agg(F.percentile("g", probs).alias("q"))
    return a.join(b, "ticker").select("ticker", F.posexplode(F.arrays_zip("p", "q")).alias("i", "z")).select("ticker", "i", F.col("z.p").alias("observed"), F.col("z.q").alias("simulated"))
