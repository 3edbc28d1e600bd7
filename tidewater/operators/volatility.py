"""Fits of conditional-volatility models, one group per ticker and model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.optim import nelder_mead

_BAD = 1e10


def _gauss(x, s2):
    return 0.5 * float((math.log(2 * math.pi) + np.log(s2) + x * x / s2).sum())


def _recursion(x: np.ndarray, first: float, step) -> np.ndarray:
    s2 = np.empty(len(x))
    v = first
    for t in range(len(x)):
        s2[t] = max(v, 1e-12)
        v = step(x[t], s2[t])
    return s2


def garch_variance(x, p):
    w, a, b = p[:3]
    return _recursion(x, w / (1 - a - b), lambda g, s: w + a * g * g + b * s)


def gjr_variance(x, p):
    w, a, c, b = p
    return _recursion(x, w / (1 - a - c / 2 - b), lambda g, s: w + (a + (c if g < 0 else 0)) * g * g + b * s)


def egarch_variance(x, p):
    w, a, c, b = p
    m = math.sqrt(2 / math.pi)

    def step(g, s):
        z = g / math.sqrt(s)
        return math.exp(min(30.0, max(-30.0, w + b * math.log(s) + a * (abs(z) - m) + c * z)))

    return _recursion(x, float(x.var(ddof=1)), step)


def _nll(model: str, x: np.ndarray):
    def garch(p):
        w, a, b = p[:3]
        return _gauss(x, garch_variance(x, p)) if w > 0 and a >= 0 and b >= 0 and a + b < 0.999 else _BAD

    def gjr(p):
        w, a, c, b = p
        return _gauss(x, gjr_variance(x, p)) if w > 0 and a >= 0 and b >= 0 and a + c >= 0 and a + b + c / 2 < 0.999 else _BAD

    def egarch(p):
        return _gauss(x, egarch_variance(x, p)) if abs(p[3]) < 0.999 else _BAD

    def garch_t(p):
        w, a, b, nu = p
        if not (w > 0 and a >= 0 and b >= 0 and a + b < 0.999 and 2.1 < nu <= 200):
            return _BAD
        s2 = garch_variance(x, p)
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return -float((c - 0.5 * np.log(s2) - (nu + 1) / 2 * np.log1p(x * x / s2 / (nu - 2))).sum())

    return {"garch": garch, "gjr": gjr, "egarch": egarch, "garch_t": garch_t}[model]


PARAMETERS = {"garch": ("omega", "alpha", "beta"), "gjr": ("omega", "alpha", "gamma", "beta"), "egarch": ("omega", "alpha", "gamma", "beta"), "garch_t": ("omega", "alpha", "beta", "nu")}


def fit_series(x: np.ndarray, model: str, most: int = 2000) -> tuple[np.ndarray, float, bool]:
    """Parameters, log-likelihood and whether the simplex converged: the best of a small grid, then a simplex."""
    v, f = float(x.var(ddof=1)), _nll(model, x)
    pairs = [(a, b) for a in (0.03, 0.1, 0.2) for b in (0.5, 0.75, 0.88) if a + b < 0.99]
    starts = {
        "garch": [(v * (1 - a - b), a, b) for a, b in pairs],
        "gjr": [(v * (1 - a - b), a / 2, a, b) for a, b in pairs],
        "egarch": [(math.log(v) * (1 - b), a, -0.05, b) for a, b in pairs],
        "garch_t": [(v * (1 - a - b), a, b, 8.0) for a, b in pairs],
    }[model]
    best = min(starts, key=lambda p: f(np.array(p)))
    p, nll, converged = nelder_mead(f, np.array(best), most=most)
    return p, -nll, bool(converged and nll < _BAD)


def fit_volatility(returns: DataFrame, models: list[str], most: int = 2000) -> DataFrame:
    """(ticker, model, params, ll, converged, n)."""
    grid = returns.select("ticker", "idx", "g").withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model = frame["model"].iloc[0]
        p, ll, converged = fit_series(frame.sort_values("idx")["g"].to_numpy(), model, most)
        return pd.DataFrame([{"ticker": frame["ticker"].iloc[0], "model": model, "params": dict(zip(PARAMETERS[model], map(float, p), strict=True)), "ll": ll, "converged": converged, "n": len(frame)}])

    return grid.groupBy("ticker", "model").applyInPandas(run, "ticker string, model string, params map<string,double>, ll double, converged boolean, n long")
