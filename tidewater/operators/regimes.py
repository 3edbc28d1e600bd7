"""Hidden Markov regime models of return series: one group per (ticker, family, k), fitted in NumPy within the group.

States are numbered from 1 and ordered by scale, the calm one first. Families: normal, t, laplace, ged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.dists import log_density, quantile
from tidewater.functions.optim import golden

MODEL = "ticker string, family string, k int, pi array<double>, trans array<array<double>>, loc array<double>, scale array<double>, shape array<double>, ll double, ll_history array<double>, n long"
SHAPE = {"normal": np.inf, "t": 6.0, "laplace": 1.0, "ged": 1.5}


def stationary(trans: np.ndarray, power: int = 1000) -> np.ndarray:
    """A row of a high power of the transition matrix, floored and normalised."""
    p = np.maximum(np.linalg.matrix_power(trans, power)[0], 1e-12)
    return p / p.sum()


def forward_backward(log_b: np.ndarray, pi: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state probabilities and summed transition probabilities, by scaled recursions."""
    n, k = log_b.shape
    top = log_b.max(1, keepdims=True)
    b = np.exp(log_b - top)
    a, c = np.empty((n, k)), np.empty(n)
    x = pi * b[0]
    for t in range(n):
        if t:
            x = (a[t - 1] @ trans) * b[t]
        c[t] = x.sum()
        a[t] = x / c[t]
    beta, xi = np.ones(k), np.zeros((k, k))
    gamma = a.copy()
    for t in range(n - 2, -1, -1):
        ahead = b[t + 1] * beta / c[t + 1]
        xi += a[t][:, None] * ahead
        beta = trans @ ahead
        gamma[t] *= beta
    return float(np.log(c).sum() + top.sum()), gamma, xi * trans


def _weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)]) if upto[-1] > 0 else float(np.median(x))


def _update(family: str, x: np.ndarray, w: np.ndarray, loc: float, scale: float, shape: float, rate: float) -> tuple[float, float, float]:
    """Location, scale and shape of one state, given the weights of its observations."""
    total = w.sum()
    if family == "laplace":
        loc = _weighted_median(x, w)
        return loc, float((w * np.abs(x - loc)).sum() / total), shape
    if family == "ged":
        spread = float(np.sqrt((w * (x - loc) ** 2).sum() / total))
        loc = golden(lambda m: -float((w * np.abs(x - m) ** shape).sum()), loc - spread, loc + spread)
        fit = lambda p: (p * float((w * np.abs(x - loc) ** p).sum() / total)) ** (1 / p)
        shape = golden(lambda p: float((w * log_density("ged", x, loc, max(fit(p), 1e-6), p)).sum()), 0.5, 3.0)
        return loc, fit(shape), shape
    u = w if family == "normal" else w * (shape + 1) / (shape + ((x - loc) / scale) ** 2)
    loc = float((u * x).sum() / u.sum())
    scale = max(float(np.sqrt((u * (x - loc) ** 2).sum() / total)), 1e-6)
    if family == "t":
        shape = golden(lambda v: float((w * log_density("t", x, loc, scale, v)).sum()) - rate / v, 2.1, 50.0)
    return loc, scale, shape


def fit(x: np.ndarray, family: str, k: int, most: int = 30, tol: float = 1e-4, update_pi: bool | None = None, rate: float = 0.0) -> dict:
    """Expectation-maximisation from sorted chunks of the data. By default the normal family keeps a uniform start, the others learn it."""
    update_pi = family != "normal" if update_pi is None else update_pi
    s, size = np.sort(x), max(1, len(x) // k)
    parts = [s[i * size : (i + 1) * size if i < k - 1 else None] for i in range(k)]
    loc = np.array([p.mean() if len(p) else s.mean() for p in parts])
    scale = np.maximum([p.std(ddof=1) if len(p) > 1 else 0.0 for p in parts], 1e-6)
    if family != "normal":
        scale = np.maximum(scale, 0.05 * x.std())
    shape, trans, pi, history, best = np.full(k, SHAPE[family]), np.full((k, k), 1 / k), np.full(k, 1 / k), [], None
    for _ in range(most):
        log_b = np.stack([log_density(family, x, loc[j], scale[j], shape[j]) for j in range(k)], 1)
        ll, gamma, xi = forward_backward(log_b, pi, trans)
        if not np.isfinite(ll):
            break
        best = (pi.copy(), trans.copy(), loc.copy(), scale.copy(), shape.copy())
        history.append(ll)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
        rows = xi.sum(1, keepdims=True)
        trans = np.where(rows > 0, xi / np.maximum(rows, 1e-300), trans)
        if update_pi:
            pi = gamma[0] / gamma[0].sum()
        for j in range(k):
            if gamma[:, j].sum() > 1e-8:
                loc[j], scale[j], shape[j] = _update(family, x, gamma[:, j], loc[j], scale[j], shape[j], rate)
                scale[j] = max(scale[j], 1e-6)
    pi, trans, loc, scale, shape = best
    order = np.argsort(scale, kind="stable")
    return {"pi": pi[order], "trans": trans[np.ix_(order, order)], "loc": loc[order], "scale": scale[order], "shape": shape[order], "ll": history[-1], "ll_history": history}


def fit_regimes(returns: DataFrame, families: list[str], ks: list[int], most: int = 30) -> DataFrame:
    """A row of MODEL per ticker, family and number of states; every combination is a group of its own."""
    grid = returns.select("ticker", "idx", "g").withColumn("family", F.explode(F.array(*[F.lit(f) for f in families]))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        family, k = frame["family"].iloc[0], int(frame["k"].iloc[0])
        m = fit(frame.sort_values("idx")["g"].to_numpy(), family, k, most)
        row = {n: v.tolist() if isinstance(v, np.ndarray) else v for n, v in m.items()}
        return pd.DataFrame([{"ticker": frame["ticker"].iloc[0], "family": family, "k": k, **row, "n": len(frame)}])

    return grid.groupBy("ticker", "family", "k").applyInPandas(run, MODEL)


def viterbi(log_b: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Most likely states (from 0) under a uniform start; the first wins ties."""
    n, k = log_b.shape
    with np.errstate(divide="ignore"):
        move = np.log(trans)
    best, back = log_b[0] - np.log(k), np.zeros((n, k), int)
    for t in range(1, n):
        step = best[:, None] + move
        back[t] = step.argmax(0)
        best = step.max(0) + log_b[t]
    path = np.empty(n, int)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _per_model(returns: DataFrame, models: DataFrame, f, schema: str) -> DataFrame:
    """f(series, model row) for every model, in one group each."""
    joined = returns.select("ticker", "idx", "g").join(models.select("ticker", "family", "k", "pi", "trans", "loc", "scale", "shape"), "ticker")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        m = frame.iloc[0]
        out = f(frame["g"].to_numpy(), m)
        return out.assign(ticker=m["ticker"], family=m["family"], k=m["k"], idx=frame["idx"].to_numpy()[: len(out)])[[c.split()[0] for c in schema.split(", ")]]

    return joined.groupBy("ticker", "family", "k").applyInPandas(run, schema)


def _log_b(x: np.ndarray, m) -> np.ndarray:
    return np.stack([log_density(m["family"], x, m["loc"][j], m["scale"][j], m["shape"][j]) for j in range(int(m["k"]))], 1)


def decode(returns: DataFrame, models: DataFrame) -> DataFrame:
    """(ticker, family, k, idx, state) by Viterbi."""
    return _per_model(returns, models, lambda x, m: pd.DataFrame({"state": viterbi(_log_b(x, m), np.stack(m["trans"])) + 1}), "ticker string, family string, k int, idx long, state int")


def mixture_quantile(alpha: float, w: np.ndarray, q: np.ndarray, cdfs) -> float:
    """Quantile of a mixture, bisected between the components' own quantiles q."""
    lo, hi = float(q.min()), float(q.max())
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(p * f(mid) for p, f in zip(w, cdfs, strict=True)) < alpha else (lo, mid)
        if hi - lo < 1e-8 * max(1.0, abs(mid)):
            break
    return (lo + hi) / 2


def conditional_var(returns: DataFrame, models: DataFrame, alpha: float) -> DataFrame:
    """(ticker, family, k, idx, var, breach): the predictive mixture's alpha-quantile before each return."""
    from tidewater.functions.dists import cdf

    def series(x: np.ndarray, m) -> pd.DataFrame:
        b, trans, k = np.exp(_log_b(x, m)), np.stack(m["trans"]), int(m["k"])
        q = np.array([m["loc"][j] + m["scale"][j] * quantile(m["family"], alpha, m["shape"][j]) for j in range(k)])
        cdfs = [lambda v, j=j: cdf(m["family"], (v - m["loc"][j]) / m["scale"][j], m["shape"][j]) for j in range(k)]
        w, out = stationary(trans), np.empty(len(x))
        for t in range(len(x)):
            out[t] = mixture_quantile(alpha, w, q, cdfs)
            z = w * b[t]
            w = (z / z.sum() if z.sum() > 0 else w) @ trans
        return pd.DataFrame({"var": out, "breach": x < out})

    return _per_model(returns, models, series, "ticker string, family string, k int, idx long, var double, breach boolean")


def walk_forward(returns: DataFrame, window: int, step: int, k: int, family: str = "normal") -> DataFrame:
    """(ticker, idx, state): the last state of a model refitted on the `window` returns up to every `step`-th one."""
    ends = returns.where((F.col("idx") >= window) & (F.col("idx") % step == 0)).select("ticker", F.col("idx").alias("end"))
    spans = ends.withColumn("idx", F.explode(F.sequence(F.col("end") - window + 1, F.col("end"))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("idx")["g"].to_numpy()
        m = {**fit(x, family, k), "family": family, "k": k}
        return pd.DataFrame({"ticker": [frame["ticker"].iloc[0]], "idx": [int(frame["end"].iloc[0])], "state": [int(viterbi(_log_b(x, m), m["trans"])[-1]) + 1]})

    return spans.join(returns.select("ticker", "idx", "g"), ["ticker", "idx"]).groupBy("ticker", "end").applyInPandas(run, "ticker string, idx long, state int")
