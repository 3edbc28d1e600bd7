"""Distributions that the box has no library for: densities, distribution functions and draws in NumPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_STANDARD = NormalDist()


def log_density(family: str, x: np.ndarray, loc, scale, shape) -> np.ndarray:
    """Log density at x. family: normal, t (shape: degrees of freedom), laplace, ged (shape: exponent)."""
    z = (x - loc) / scale
    if family == "normal":
        return -0.5 * (z * z + math.log(2 * math.pi)) - np.log(scale)
    if family == "t":
        c = _lgamma((np.asarray(shape) + 1) / 2) - _lgamma(np.asarray(shape) / 2) - 0.5 * np.log(shape * np.pi)
        return c - np.log(scale) - (np.asarray(shape) + 1) / 2 * np.log1p(z * z / shape)
    if family == "laplace":
        return -np.abs(z) - np.log(2 * np.asarray(scale))
    if family == "ged":
        p = np.asarray(shape)
        return np.log(p) - np.log(2 * np.asarray(scale)) - _lgamma(1 / p) - np.abs(z) ** p
    raise ValueError(f"unknown family {family}")


def draw(family: str, shape: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Standard draws, one for each shape."""
    n = len(shape)
    if family == "normal":
        return rng.standard_normal(n)
    if family == "t":
        return rng.standard_normal(n) / np.sqrt(rng.chisquare(shape) / shape)
    if family == "laplace":
        return rng.laplace(size=n)
    if family == "ged":
        return rng.choice([-1.0, 1.0], n) * rng.gamma(1 / shape) ** (1 / shape)
    raise ValueError(f"unknown family {family}")


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * lead
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * lead


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + an * d or 1e-300)
            c = 1 + an / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_cdf(k / 2, x / 2)


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * beta_cdf(nu / 2, 0.5, nu / (nu + x * x))
    return 1 - tail if x > 0 else tail


def f_sf(x: float, a: float, b: float) -> float:
    return beta_cdf(b / 2, a / 2, b / (b + a * x)) if x > 0 else 1.0


def cdf(family: str, z: float, shape: float) -> float:
    """Distribution function of the standard member of a family."""
    if family == "normal":
        return _STANDARD.cdf(z)
    if family == "t":
        return t_cdf(z, shape)
    if family == "laplace":
        return 0.5 * math.exp(z) if z < 0 else 1 - 0.5 * math.exp(-z)
    if family == "ged":
        half = 0.5 * gamma_cdf(1 / shape, abs(z) ** shape)
        return 0.5 + half if z > 0 else 0.5 - half
    raise ValueError(f"unknown family {family}")


def quantile(family: str, p: float, shape: float) -> float:
    """Inverse of cdf by bisection."""
    if family == "normal":
        return _STANDARD.inv_cdf(p)
    lo, hi = -1.0, 1.0
    while cdf(family, lo, shape) > p:
        lo *= 2
    while cdf(family, hi, shape) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(family, mid, shape) < p else (lo, mid)
        if hi - lo < 1e-12 * max(1, abs(mid)):
            break
    return (lo + hi) / 2
