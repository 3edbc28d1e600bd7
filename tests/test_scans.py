"""Scans over segments equal the recursions step by step."""

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import likelihoods, scans

OMEGA, ALPHA, BETA, MU = [0.02, 0.2], [0.05, 0.1], [0.9, 0.8], 0.01
MOVE = [[0.98, 0.02], [0.05, 0.95]]


def by_hand(x):
    p, s2, out = None, np.array([o / (1 - a - b) for o, a, b in zip(OMEGA, ALPHA, BETA, strict=True)]), []
    for t, v in enumerate(x):
        pred = np.array(scans.stationary(MOVE)) if t == 0 else np.array(MOVE).T @ p
        logf = -0.5 * np.log(2 * np.pi * s2) - 0.5 * (v - MU) ** 2 / s2
        raw = pred * np.exp(logf - logf.max())
        p = raw / raw.sum()
        out.append([*s2, *pred, *p, logf.max() + np.log(raw.sum())])
        s2 = np.maximum(np.array(OMEGA) + np.array(ALPHA) * (v - MU) ** 2 + np.array(BETA) * s2, 1e-12)
    return np.array(out)


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"ticker": "X", "idx": np.arange(1, len(x) + 1), "g": x}))


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 20_000])
def test_hamilton_filter(spark, n):
    x = np.random.default_rng(n).normal(size=n) * np.where(np.arange(n) // 300 % 2, 0.5, 3)
    rows = scans.hamilton_filter(frame(spark, x), OMEGA, ALPHA, BETA, MU, MOVE).orderBy("idx").collect()
    got = np.array([[*r.s2, *r.pred, *r.p, r.ll] for r in rows])
    assert np.abs(got - by_hand(x)).max() < 1e-11


def test_extreme_steps_keep_the_prediction(spark):
    x = np.array([0.1, 1e200, -0.2, 1e200, 0.3])
    got = likelihoods.filtered_states(frame(spark, x), MOVE, [0.5, 2.0])
    rows = got.orderBy("idx").collect()
    assert all(abs(sum(r.p) - 1) < 1e-12 for r in rows)
    assert np.allclose(rows[1].p, rows[1].pred, rtol=1e-12) and np.allclose(rows[3].p, rows[3].pred, rtol=1e-12)
    ahead = scans.predictive(got, MOVE).orderBy("idx").collect()
    assert [r.idx for r in ahead] == [1, 2, 3, 4, 5, 6]
    assert np.allclose(ahead[5].pred, np.array(MOVE).T @ rows[4].p)


def test_variance_floor(spark):
    got = scans.variance_paths(frame(spark, np.zeros(400)), [0.0], [0.1], [0.5]).orderBy("idx").collect()
    assert got[0].s2 == [1e-12] or got[0].s2 == [0.0]
    assert all(r.s2 == [1e-12] for r in got[1:])
