"""Fixed-parameter recursions as ordered folds: one array per ticker, one aggregate() over it, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def series(returns: DataFrame, x: str = "g") -> DataFrame:
    """(ticker, v): the ordered values of each ticker."""
    return returns.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(x).alias("v")))), lambda s: s["v"]).alias("v"))


def _fold(name: str, step: str, start: str, end: str) -> str:
    return f"aggregate(v, {start}, (s, x) -> {step}, s -> {end}) as {name}"


def garch_likelihood(held: DataFrame, omega: str, alpha: str, beta: str, mu: str = "0D") -> DataFrame:
    """Gaussian log-likelihood and next variance of GARCH(1,1), from the unconditional variance, floored at 1e-12. Parameters are expressions over held's columns."""
    s2 = "greatest(s.s2, 1e-12D)"
    step = f"named_struct('s2', {omega} + {alpha} * (x - {mu}) * (x - {mu}) + {beta} * {s2}, 'll', s.ll - 0.5D * (ln(2D * pi()) + ln({s2}) + (x - {mu}) * (x - {mu}) / {s2}))"
    start = f"named_struct('s2', cast({omega} / (1D - {alpha} - {beta}) as double), 'll', 0D)"
    return held.selectExpr(*[c for c in held.columns if c != "v"], _fold("f", step, start, "s")).select("*", "f.ll", "f.s2").drop("f")


def gjr_likelihood(held: DataFrame, omega: str, alpha: str, gamma: str, beta: str) -> DataFrame:
    """As GARCH, with gamma more on negative shocks."""
    s2 = "greatest(s.s2, 1e-12D)"
    step = f"named_struct('s2', {omega} + ({alpha} + if(x < 0, {gamma}, 0D)) * x * x + {beta} * {s2}, 'll', s.ll - 0.5D * (ln(2D * pi()) + ln({s2}) + x * x / {s2}))"
    start = f"named_struct('s2', cast({omega} / (1D - {alpha} - {gamma} / 2D - {beta}) as double), 'll', 0D)"
    return held.selectExpr(*[c for c in held.columns if c != "v"], _fold("f", step, start, "s")).select("*", "f.ll", "f.s2").drop("f")


def egarch_likelihood(held: DataFrame, omega: str, alpha: str, gamma: str, beta: str, var0: str) -> DataFrame:
    """Log variance recursion, clamped to 30 either way, from the log of var0."""
    z = "(x / exp(s.h / 2D))"
    step = f"named_struct('h', least(30D, greatest(-30D, {omega} + {beta} * s.h + {alpha} * (abs({z}) - sqrt(2D / pi())) + {gamma} * {z})), 'll', s.ll - 0.5D * (ln(2D * pi()) + s.h + {z} * {z}))"
    start = f"named_struct('h', cast(ln({var0}) as double), 'll', 0D)"
    return held.selectExpr(*[c for c in held.columns if c != "v"], _fold("f", step, start, "s")).select("*", "f.ll", F.exp("f.h").alias("s2")).drop("f")


def garch_grid(held: DataFrame, variance: str, alphas: list[float], betas: list[float], mu: str = "0D") -> DataFrame:
    """Best (alpha, beta) of a grid with omega matched to the sample variance: grid rows by ticker, one fold each."""
    pairs = ", ".join(f"named_struct('alpha', {a}D, 'beta', {b}D)" for a in alphas for b in betas if a + b < 0.999)
    grid = held.selectExpr("*", f"explode(array({pairs})) as p").selectExpr("*", f"{variance} * (1D - p.alpha - p.beta) as omega", "p.alpha as alpha", "p.beta as beta").drop("p")
    scored = garch_likelihood(grid, "omega", "alpha", "beta", mu)
    return scored.groupBy("ticker").agg(F.max_by(F.struct("alpha", "beta", "omega", "ll"), F.struct("ll", "alpha", "beta")).alias("b")).select("ticker", "b.*")


def two_state_filter(held: DataFrame, stay: tuple[float, float], sigma: tuple[float, float]) -> DataFrame:
    """Forward filter of a two-state zero-mean Gaussian model: log-likelihood and the next step's state probabilities."""
    a, b = stay
    p0 = (1 - b) / (2 - a - b)
    pdf = [f"(exp(-0.5D * x * x / {s * s}D) / ({s}D * sqrt(2D * pi())))" for s in sigma]
    z = f"(s.p * {pdf[0]} + (1D - s.p) * {pdf[1]})"
    post = f"if({z} > 0D, s.p * {pdf[0]} / nullif({z}, 0D), s.p)"
    step = f"named_struct('p', {post} * {a}D + (1D - {post}) * {1 - b}D, 'll', s.ll + if({z} > 0D, ln({z}), 0D))"
    return held.selectExpr("ticker", _fold("f", step, f"named_struct('p', {p0}D, 'll', 0D)", "s")).select("ticker", "f.ll", "f.p")


def caviar_path(held: DataFrame, b1: str, b2: str, b3: str, q0: str, alpha: float) -> DataFrame:
    """Symmetric absolute value CAViaR: q_t = b1 + b2 q_{t-1} + b3 |x_{t-1}|; mean tick loss and the next quantile."""
    hit = "if(x < s.q, 1D, 0D)"
    step = f"named_struct('q', {b1} + {b2} * s.q + {b3} * abs(x), 'loss', s.loss + ({alpha}D - {hit}) * (x - s.q), 'hits', s.hits + {hit})"
    return held.selectExpr("ticker", "size(v) as n", _fold("f", step, f"named_struct('q', cast({q0} as double), 'loss', 0D, 'hits', 0D)", "s")).selectExpr("ticker", "f.loss / n as loss", "f.q as q_next", "cast(f.hits as long) as breaches")
