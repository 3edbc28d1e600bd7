"""Simulated paths. Draws are keyed by (seed, path, step), so they don't depend on partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_M = 2147483647


def hash_uniform(path: Column, t: Column, seed: int = 1) -> Column:
    """A uniform number in (0, 1) from integer arithmetic that SQL engines share; test-grade."""
    p, t, m = path.cast("long"), t.cast("long"), F.lit(_M).cast("long")
    h = (p * 1103515245 + t * 69069069 + F.lit(seed * 40692 + 12345).cast("long")) % m
    h = (h * h + h * 48271 + 7) % m
    h = (h * 16807 + t) % m
    h = (h * h + h * 69621 + 11) % m
    return (h + F.lit(0.5)) / F.lit(float(_M))


def steps(spark: SparkSession, n_paths: int, n_steps: int) -> DataFrame:
    """(path_id, t), both from 1."""
    return spark.range(1, n_paths + 1).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_steps).cast("long"))).alias("t"))


def bootstrap_paths(returns: DataFrame, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """Independent draws with replacement from each ticker's returns."""
    n = returns.groupBy("ticker").agg(F.count("*").alias("n"))
    u = steps(returns.sparkSession, n_paths, n_steps).withColumn("u", hash_uniform(F.col("path_id"), F.col("t"), seed))
    drawn = u.join(F.broadcast(n)).withColumn("idx", (F.floor(F.col("u") * F.col("n")) + 1).cast("long"))
    return drawn.join(returns.select("ticker", "idx", "g"), ["ticker", "idx"]).select("ticker", "path_id", "t", "g")


def laplace_paths(fits: DataFrame, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """Independent Laplace draws by inverse distribution; fits: ticker, location, scale."""
    u = steps(fits.sparkSession, n_paths, n_steps).withColumn("u", hash_uniform(F.col("path_id"), F.col("t"), seed) - 0.5)
    g = F.col("location") - F.col("scale") * F.signum("u") * F.log(1 - 2 * F.abs("u"))
    return u.join(F.broadcast(fits)).select("ticker", "path_id", "t", g.alias("g"))


def markov_walk(matrix: DataFrame, n_paths: int, n_steps: int, start: int = 1, seed: int = 1) -> DataFrame:
    """Discrete chain from `start`, one fold per path over its hashed uniforms. matrix: ticker, from_state, to_state, p."""
    rows = matrix.groupBy("ticker", "from_state").agg(F.transform(F.array_sort(F.collect_list(F.struct("to_state", "p"))), lambda s: s["p"]).alias("p"))
    rows = rows.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("from_state", "p"))), lambda s: s["p"]).alias("rows"))
    u = steps(matrix.sparkSession, n_paths, n_steps).withColumn("u", hash_uniform(F.col("path_id"), F.col("t"), seed))
    u = u.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "u"))), lambda s: s["u"]).alias("u"))
    move = "aggregate(element_at(rows, element_at(s, -1)), named_struct('c', 0D, 'k', 1), (a, p) -> named_struct('c', a.c + p, 'k', a.k + if(x >= a.c + p, 1, 0)), a -> least(a.k, size(rows)))"
    walk = F.expr(f"aggregate(u, array({start}), (s, x) -> array_append(s, {move}))")
    return u.join(F.broadcast(rows)).select("ticker", "path_id", F.posexplode(walk).alias("t", "state"))


def regime_paths(models: DataFrame, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """Paths of fitted regime models: (ticker, family, k, path_id, t, state, g), from the stationary start.

    Each (model, path) is a row and draws from its own counter-based generator, so tasks may be any size.
    """
    from tidewater.functions.dists import draw
    from tidewater.operators.regimes import stationary

    grid = models.select("ticker", "family", "k", "trans", "loc", "scale", "shape").join(models.sparkSession.range(1, n_paths + 1).withColumnRenamed("id", "path_id"))

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                key = [seed, int(r.path_id), *(ord(c) for c in f"{r.ticker}|{r.family}|{r.k}")]
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))
                trans = np.stack(r.trans)
                cum = np.cumsum(trans, axis=1)
                state = np.empty(n_steps, np.int64)
                u = rng.random(n_steps)
                state[0] = min(int(np.searchsorted(np.cumsum(stationary(trans)), u[0], side="right")), r.k - 1)
                for t in range(1, n_steps):
                    state[t] = min(int(np.searchsorted(cum[state[t - 1]], u[t], side="right")), r.k - 1)
                g = np.asarray(r.loc)[state] + np.asarray(r.scale)[state] * draw(r.family, np.asarray(r.shape)[state], rng)
                yield pd.DataFrame({"ticker": r.ticker, "family": r.family, "k": r.k, "path_id": r.path_id, "t": np.arange(1, n_steps + 1), "state": state + 1, "g": g})

    return grid.repartition("ticker", "family", "k", "path_id").mapInPandas(run, "ticker string, family string, k int, path_id long, t long, state long, g double")


def block_bootstrap(returns: DataFrame, n_paths: int, block: float, seed: int = 1) -> DataFrame:
    """Stationary block bootstrap of each ticker: blocks of geometric length with the given mean, wrapping at the end."""
    grid = returns.sparkSession.range(1, n_paths + 1).withColumnRenamed("id", "path_id")
    held = returns.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "g"))), lambda s: s["g"]).alias("v"))

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(r.path_id), *map(ord, r.ticker)])))
                v = np.asarray(r.v)
                n = len(v)
                new = rng.random(n) < 1 / block
                new[0] = True
                at = np.flatnonzero(new)
                begin = rng.integers(0, n, len(at))
                run_of = np.cumsum(new) - 1
                g = v[(begin[run_of] + np.arange(n) - at[run_of]) % n]
                yield pd.DataFrame({"ticker": r.ticker, "path_id": r.path_id, "t": np.arange(1, n + 1), "g": g})

    return held.join(grid).repartition("ticker", "path_id").mapInPandas(run, "ticker string, path_id long, t long, g double")


def garch_paths(fits: DataFrame, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """Gaussian GARCH(1,1) paths from the unconditional variance; fits: ticker, omega, alpha, beta."""
    grid = fits.select("ticker", "omega", "alpha", "beta").join(fits.sparkSession.range(1, n_paths + 1).withColumnRenamed("id", "path_id"))

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(r.path_id), *map(ord, r.ticker)])))
                z, g, s2 = rng.standard_normal(n_steps), np.empty(n_steps), r.omega / (1 - r.alpha - r.beta)
                for t in range(n_steps):
                    g[t] = np.sqrt(s2) * z[t]
                    s2 = r.omega + r.alpha * g[t] ** 2 + r.beta * s2
                yield pd.DataFrame({"ticker": r.ticker, "path_id": r.path_id, "t": np.arange(1, n_steps + 1), "g": g})

    return grid.repartition("ticker", "path_id").mapInPandas(run, "ticker string, path_id long, t long, g double")


def gaussian_paths(returns: DataFrame, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """Independent normal draws of each ticker's mean and deviation, by pairs of hashed uniforms."""
    fits = returns.groupBy("ticker").agg(F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"))
    u = steps(returns.sparkSession, n_paths, n_steps)
    u = u.withColumn("a", hash_uniform(F.col("path_id"), F.col("t"), 2 * seed)).withColumn("b", hash_uniform(F.col("path_id"), F.col("t"), 2 * seed + 1))
    z = F.sqrt(-2 * F.log("a")) * F.cos(2 * F.pi() * F.col("b"))
    return u.join(fits).select("ticker", "path_id", "t", (F.col("mean") + F.col("sd") * z).alias("g"))


def index_residuals(returns: DataFrame, market: str) -> DataFrame:
    """(ticker, place, alpha, beta, residual): what the line on the market ticker leaves, on common dates in their order."""
    m = returns.where(F.col("ticker") == market).select("dt", F.col("g").alias("x"))
    rows = returns.where(F.col("ticker") != market).select("ticker", "dt", "g").join(m, "dt")
    fits = rows.groupBy("ticker").agg(F.regr_slope("g", "x").alias("beta"), F.regr_intercept("g", "x").alias("alpha"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("dt")).cast("long")
    return rows.withColumn("place", place).join(fits, "ticker").select("ticker", "place", "alpha", "beta", (F.col("g") - F.col("alpha") - F.col("beta") * F.col("x")).alias("residual"))


def index_paths(residuals: DataFrame, market_paths: DataFrame, seed: int = 1) -> DataFrame:
    """(ticker, path_id, t, g): the line at each step of a market path (path_id, t, m), and a residual drawn with replacement."""
    fits = residuals.groupBy("ticker").agg(F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.count("*").alias("n"))
    drawn = market_paths.join(fits).withColumn("place", (F.floor(hash_uniform(F.col("path_id"), F.col("t"), seed) * F.col("n")) + 1).cast("long"))
    return drawn.join(residuals.select("ticker", "place", "residual"), ["ticker", "place"]).select("ticker", "path_id", "t", (F.col("alpha") + F.col("beta") * F.col("m") + F.col("residual")).alias("g"))
