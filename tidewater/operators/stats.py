"""Descriptive statistics of return series: one row (or few) per ticker, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

X = "g"


def sample_skewness(x: str = X) -> Column:
    """Mean cubed deviation over the n-1 standard deviation cubed."""
    n = F.count(x)
    return F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))


def sample_excess_kurtosis(x: str = X) -> Column:
    """Mean fourth deviation over the n-1 variance squared, less 3. F.kurtosis is the population form."""
    n = F.count(x)
    return (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3


def descriptives(returns: DataFrame) -> DataFrame:
    """n, mean, sd, skewness, excess kurtosis and the Jarque-Bera statistic per ticker."""
    out = returns.groupBy("ticker").agg(F.count(X).alias("n"), F.avg(X).alias("mean"), F.stddev_samp(X).alias("sd"), sample_skewness().alias("skew"), sample_excess_kurtosis().alias("kurt"))
    return out.withColumn("jb", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4))


def autocorrelations(returns: DataFrame, lags: int, x: str = X) -> DataFrame:
    """(ticker, lag, rho) with the whole series' mean and sum of squares; one shuffle by ticker, the lags within an array."""
    held = returns.groupBy("ticker").agg(F.avg(x).alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(x).alias("v")))), lambda s: s["v"]).alias("v"))
    held = held.withColumn("d", F.expr("transform(v, x -> x - m)")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    num = F.expr("aggregate(zip_with(slice(d, 1, size(d) - k), slice(d, k + 1, size(d) - k), (a, b) -> a * b), 0D, (s, x) -> s + x)")
    den = F.expr("aggregate(d, 0D, (s, x) -> s + x * x)")
    return held.where("k < size(d)").select("ticker", F.col("k").alias("lag"), F.try_divide(num, den).alias("rho"))


def path_autocorrelations(paths: DataFrame, lags: int) -> DataFrame:
    """(ticker, path, lag, rho) of every path (ticker, path_id, t, g)."""
    rows = paths.select(F.struct("ticker", "path_id").alias("ticker"), F.col("t").alias("idx"), "g")
    return autocorrelations(rows, lags).select("ticker.ticker", F.col("ticker.path_id").alias("path"), "lag", "rho")


def ljung_box(returns: DataFrame, lags: int = 20, x: str = X) -> DataFrame:
    """n (n + 2) sum of rho_k^2 / (n - k)."""
    n = returns.groupBy("ticker").agg(F.count(x).alias("n"))
    rho = autocorrelations(returns, lags, x)
    return rho.join(n, "ticker").groupBy("ticker").agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("rho") ** 2 / (F.col("n") - F.col("lag")))).alias("q"))


def laplace_fit(returns: DataFrame) -> DataFrame:
    """Location (median) and scale (mean absolute deviation from it)."""
    mid = returns.groupBy("ticker").agg(F.expr(f"percentile({X}, 0.5)").alias("location"))
    return returns.join(mid, "ticker").groupBy("ticker").agg(F.first("location").alias("location"), F.avg(F.abs(F.col(X) - F.col("location"))).alias("scale"))


#: How often weighted_median halves the values into stretches.
HALVINGS = 10


def _stretch(rows: DataFrame, value: str, halvings: int) -> Column:
    """Number of the value's stretch, of about equally many rows each; edges are approximate, but every value is in one."""
    n = 1 << halvings
    edges = rows.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 4 * n)).first()[0]
    if not edges:
        return F.lit(0)
    tree = F.lit([edges[n * (2 * i + 1) // (2 << level) - 1] for level in range(halvings) for i in range(1 << level)])  # below place i: 2 i, 2 i + 1
    return F.aggregate(F.lit([0] * halvings), F.lit(1), lambda i, _: 2 * i + (F.col(value) >= F.element_at(tree, i)).cast("int")) - n


def weighted_median(rows: DataFrame, key: str, value: str, weight: str, halvings: int = HALVINGS) -> DataFrame:
    """The first value, in order, at which the summed weight reaches half of all; the median where no weight is positive.

    Weights are summed by value; values are dealt to stretches, so that a key's rows don't meet in one task: sums run within
    a stretch, from what the stretches before it hold.
    """
    rows = rows.where(F.col(value).isNotNull())
    held = rows.groupBy(F.struct(key).alias("k"), value).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))  # a null key is a group
    held = held.withColumn("stretch", F.explode(F.array(_stretch(rows, value, halvings))))  # exploded: else a filter that Spark infers for the join fails
    sums = held.groupBy("k", "stretch").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    by = Window.partitionBy("k")
    before = by.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("k", "stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "wn"], *[F.sum(c).over(by).alias(f"{c}_all") for c in "wn"])
    upto = Window.partitionBy("k", "stretch").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = held.select("k", "stretch", value, *[F.sum(c).over(upto).alias(f"{c}_upto") for c in "wn"])
    joined = within.join(sums, ["k", "stretch"])
    w, n = (F.col(f"{c}_before") + F.coalesce(f"{c}_upto", F.lit(0)) for c in "wn")
    first = lambda found: F.min(F.when(found, F.col(value)))
    middle = 0.5 * first(n >= F.col("n_all") / 2) + 0.5 * first(n > F.col("n_all") / 2)
    out = joined.groupBy("k").agg(F.when(F.first("w_all") > 0, first(w >= F.col("w_all") / 2)).otherwise(middle).alias("weighted_median"))
    return out.select(F.col(f"k.{key}").alias(key), "weighted_median")


def quantile_grid(returns: DataFrame, n: int = 99) -> DataFrame:
    """(ticker, p, q): interpolated quantiles at 1/(n+1) .. n/(n+1)."""
    probs = F.array(*[F.lit(i / (n + 1)) for i in range(1, n + 1)])
    out = returns.groupBy("ticker").agg(F.percentile(X, probs).alias("q"))
    return out.select("ticker", F.posexplode("q").alias("i", "q")).select("ticker", (F.col("i") + 1).alias("i"), "q")


def ordinal_bins(returns: DataFrame, bins: int) -> DataFrame:
    """returns with `bin` from 1: the first k with x below quantile edge k; the last bin takes the rest."""
    edges = returns.groupBy("ticker").agg(F.percentile(X, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    found = F.size(F.filter("edges", lambda e: e <= F.col(X))) + 1
    return returns.join(edges, "ticker").withColumn("bin", found.cast("int")).drop("edges")


def transition_matrix(binned: DataFrame, bins: int, state: str = "bin") -> DataFrame:
    """(ticker, from_state, to_state, n, p); a state that is never left gets uniform rows."""
    w = Window.partitionBy("ticker").orderBy("idx")
    counts = binned.withColumn("to_state", F.lead(state).over(w)).where("to_state is not null").groupBy("ticker", F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    states = F.sequence(F.lit(1), F.lit(bins))
    grid = binned.select("ticker").distinct().withColumn("from_state", F.explode(states)).withColumn("to_state", F.explode(states))
    full = grid.join(counts, ["ticker", "from_state", "to_state"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("ticker", "from_state"))
    return full.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(1 / bins))


def state_runs(binned: DataFrame, state: str = "bin") -> DataFrame:
    """Maximal runs of one state: (ticker, run, state, length)."""
    w = Window.partitionBy("ticker").orderBy("idx")
    new = F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1)
    runs = binned.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("ticker", "run").agg(F.first(state).alias("state"), F.count("*").alias("length"))


def sojourn_moments(runs: DataFrame) -> DataFrame:
    """Per state, from the lengths of its runs: a negative binomial by moments, geometric (r null) below three runs or where the
    variance isn't above the mean; and a truncated Pareto's tail index, 1.5 where all lengths are the least, and its end."""
    out = runs.groupBy("ticker", "state").agg(
        F.count("*").alias("n_runs"), F.avg("length").alias("mean_len"), F.var_samp("length").alias("var_len"),
        F.min("length").alias("d_min"), F.max("length").alias("longest"), F.sum(F.log("length")).alias("s_log"),
    )
    m, v = F.col("mean_len"), F.col("var_len")
    spread = (F.col("n_runs") >= 3) & (v > m)
    r = F.when(spread, F.greatest(F.lit(0.1), m * m / F.nullif(v - m, F.lit(0.0))))
    p = F.when(spread, F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), m / v))).otherwise(1 / F.greatest(m, F.lit(1.0)))
    gaps = F.col("s_log") - F.col("n_runs") * F.log("d_min")
    hill = F.when(gaps > 1e-12, F.col("n_runs") / gaps).otherwise(1.5)
    alpha = F.least(F.lit(5.0), F.greatest(F.lit(0.3), hill))
    return out.select("ticker", "state", "n_runs", "mean_len", "var_len", r.alias("nb_r"), p.alias("nb_p"), alpha.alias("pareto_alpha"), F.greatest(2 * F.col("longest"), F.lit(100)).alias("d_max"))


def within_state_ar1(binned: DataFrame, state: str = "bin") -> DataFrame:
    """Slope (clamped to 0.999) and intercept of x_t on x_{t-1} over consecutive steps in one state."""
    w = Window.partitionBy("ticker").orderBy("idx")
    pairs = binned.withColumn("x", F.lag(X).over(w)).withColumn("before", F.lag(state).over(w)).where(F.col("before") == F.col(state))
    slope = F.least(F.lit(0.999), F.greatest(F.lit(-0.999), F.regr_slope(X, "x")))
    return pairs.groupBy("ticker", F.col(state).alias("state")).agg(F.count("*").alias("n"), slope.alias("phi"), F.regr_intercept(X, "x").alias("intercept"))


def initial_states(returns: DataFrame, k: int, floor: float = 1e-6) -> DataFrame:
    """Start of an EM fit: sorted values in k chunks of equal size, the last with the remainder; mean and sd of each."""
    w = Window.partitionBy("ticker")
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / k))
    chunk = F.least(F.floor((F.row_number().over(w.orderBy(X, "idx")) - 1) / size), F.lit(k - 1)) + 1
    return returns.withColumn("state", chunk.cast("int")).groupBy("ticker", "state").agg(F.avg(X).alias("mu"), F.greatest(F.coalesce(F.stddev_samp(X), F.lit(floor)), F.lit(floor)).alias("sigma"), F.count("*").alias("n"))


def histogram(returns: DataFrame, lo: float, width: float) -> DataFrame:
    """Left-closed bins of fixed width."""
    return returns.groupBy("ticker", F.floor((F.col(X) - lo) / width).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def one_way_anova(returns: DataFrame) -> DataFrame:
    """F statistic and eta squared of the tickers' means."""
    groups = returns.groupBy("ticker").agg(F.count(X).alias("n"), F.avg(X).alias("m"), F.var_pop(X).alias("v"))
    total = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") ** 2).alias("raw"))
    between = F.col("raw") - F.col("n_all") * F.col("grand") ** 2
    return total.select("k", "n_all", ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n_all") - F.col("k")))).alias("f"), (between / (between + F.col("within"))).alias("eta2"))


def aligned(returns: DataFrame, a: str, b: str) -> DataFrame:
    """(dt, x, y) on common dates."""
    left = returns.where(F.col("ticker") == a).select("dt", F.col(X).alias("x"))
    return left.join(returns.where(F.col("ticker") == b).select("dt", F.col(X).alias("y")), "dt")


def market_model(returns: DataFrame, market: str) -> DataFrame:
    """alpha, beta, R squared and residual sd of each other ticker on the market's return of the same date."""
    m = returns.where(F.col("ticker") == market).select("dt", F.col(X).alias("m"))
    rows = returns.where(F.col("ticker") != market).join(m, "dt")
    out = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.regr_intercept(X, "m").alias("alpha"), F.regr_slope(X, "m").alias("beta"), F.regr_r2(X, "m").alias("r2"), F.regr_syy(X, "m").alias("syy"))
    return out.select("ticker", "n", "alpha", "beta", "r2", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") * (1 - F.col("r2"))) / (F.col("n") - 2)).alias("resid_sd"))


def correlation_pairs(returns: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of tickers on common dates."""
    a = returns.select("dt", F.col("ticker").alias("a"), F.col(X).alias("x"))
    b = returns.select("dt", F.col("ticker").alias("b"), F.col(X).alias("y"))
    return a.join(b, "dt").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))


def probability_ranks(returns: DataFrame) -> DataFrame:
    """Ordinal rank / (n + 1), ties by position."""
    w = Window.partitionBy("ticker")
    return returns.withColumn("u", F.row_number().over(w.orderBy(X, "idx")) / (F.count("*").over(w) + 1))
