"""Small optimisers for model fits within a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def golden(f: Callable[[float], float], lo: float, hi: float, steps: int = 40) -> float:
    """Where f is largest on [lo, hi], for f with one peak."""
    r = (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa >= fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 1.2, most: int = 2000, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """Smallest f found by a simplex from `start`, and whether its corners agree within tol; infeasible points should give a large f."""
    start = np.asarray(start, float)
    simplex = [start] + [np.where(np.arange(len(start)) == i, np.where(start == 0, 0.1, start * step), start) for i in range(len(start))]
    held = sorted(((f(x), i, x) for i, x in enumerate(simplex)), key=lambda v: v[:2])
    for n in range(most):
        if abs(held[-1][0] - held[0][0]) < tol:
            break
        centre = np.mean([x for _, _, x in held[:-1]], axis=0)
        worst = held[-1]
        trial = centre + (centre - worst[2])
        v = f(trial)
        if v < held[0][0]:
            far = centre + 2 * (centre - worst[2])
            w = f(far)
            new = (w, n, far) if w < v else (v, n, trial)
        elif v < held[-2][0]:
            new = (v, n, trial)
        else:
            near = centre + 0.5 * (worst[2] - centre)
            w = f(near)
            if w < worst[0]:
                new = (w, n, near)
            else:
                best = held[0][2]
                held = [held[0]] + [(f(y := best + 0.5 * (x - best)), i, y) for _, i, x in held[1:]]
                held.sort(key=lambda t: t[:2])
                continue
        held = sorted([*held[:-1], new], key=lambda t: t[:2])
    return held[0][2], held[0][0], abs(held[-1][0] - held[0][0]) < tol
