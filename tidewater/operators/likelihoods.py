"""Filters and likelihoods at given parameters, as scans over segments, folds over a ticker's ordered array or plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import scans


def garch_variance_path(rows: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """(ticker, idx, x, s2): the conditional variance of every step, given the steps before it; from the unconditional variance."""
    return scans.variance_paths(rows, [omega], [alpha], [beta]).select("ticker", "idx", "x", F.col("s2")[0].alias("s2"))


def stochastic_volatility(held: DataFrame, phi: float, eta2: float, log_s2: str, noise: float = 4.9348) -> DataFrame:
    """Kalman quasi-likelihood of log squares y around a level: x_t = (1 - phi) level + phi x_{t-1} + N(0, eta2), y = x + N(0, noise)."""
    p = f"({phi * phi}D * s.p + {eta2}D)"
    m = f"({1 - phi!r}D * {log_s2} + {phi}D * s.x)"
    s = f"({p} + {noise}D)"
    step = f"named_struct('x', {m} + {p} / {s} * (y - {m}), 'p', (1D - {p} / {s}) * {p}, 'll', s.ll - 0.5D * (ln(2D * pi() * {s}) + (y - {m}) * (y - {m}) / {s}))"
    fold = f"aggregate(v, named_struct('x', cast({log_s2} as double), 'p', {eta2 / max(1 - phi * phi, 1e-8)!r}D, 'll', 0D), (s, y) -> {step}) as f"
    return held.selectExpr("ticker", fold).select("ticker", "f.ll", F.col("f.x").alias("level"))


def jump_diffusion(rows: DataFrame, mu: float, sigma: float, rate: float, jump_mu: float, jump_sigma: float, terms: int = 20) -> DataFrame:
    """Log-likelihood of a Gaussian step with a Poisson number of Gaussian jumps; 0 to `terms` jumps."""
    weights = ", ".join(f"named_struct('k', {k}, 'w', {k} * ln({rate}D) - {rate}D - aggregate(sequence(1, {max(k, 1)}), 0D, (s, i) -> s + ln(i)))" for k in range(terms + 1))
    v = f"({sigma * sigma!r}D + t.k * {jump_sigma * jump_sigma!r}D)"
    d = f"(g - {mu}D - t.k * {jump_mu}D)"
    density = f"aggregate(transform(array({weights}), t -> exp(t.w - 0.5D * (ln(2D * pi() * {v}) + {d} * {d} / {v}))), 0D, (s, x) -> s + x)"
    return rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.log(F.expr(density))).alias("ll"))


def filtered_states(rows: DataFrame, move: list[list[float]], sigma: list[float], prior: list[float] | None = None) -> DataFrame:
    """(ticker, idx, x, pred, p, ll): probabilities of zero-mean Gaussian states given the steps up to each, and the step's log density; from a uniform prior."""
    steps = rows.select("ticker", "idx", F.col("g").alias("x")).withColumn("logf", F.expr(scans.gaussian_logs("x", [f"{s * s!r}D" for s in sigma])))
    return scans.state_filter(steps, move, prior or [1 / len(sigma)] * len(sigma), ("x",))


def state_band(filtered: DataFrame, lowest: int, highest: int) -> DataFrame:
    """Mass of the states whose numbers lie in a band, at every step."""
    return filtered.select("ticker", "idx", F.aggregate(F.slice("p", lowest, highest - lowest + 1), F.lit(0.0), lambda s, x: s + x).alias("mass"))
