import numpy as np
import pytest

from tidewater.operators import volatility
from tidewater.plans import models


def garch(n=1500, seed=8):
    rng, s, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        out.append(rng.normal() * np.sqrt(s))
        s = 0.05 + 0.1 * out[-1] ** 2 + 0.85 * s
    return np.array(out)


@pytest.fixture
def rows(spark, monkeypatch):
    x = garch()
    df = spark.createDataFrame([("X", i + 1, float(v)) for i, v in enumerate(x)], "ticker string, idx long, g double")
    monkeypatch.setattr(models, "_scaled", lambda *_: df)
    return x


def test_fits_are_maxima(spark, rows):
    got = models.volatility_fits(spark, "").collect()
    assert len(got) == 4
    for r in got:
        assert r.converged
        f, p = volatility._nll(r.model, rows), np.array([r.params[c] for c in volatility.PARAMETERS[r.model]])
        for i in range(len(p)):
            for step in (-1e-3, 1e-3):
                q = p.copy()
                q[i] += step * max(abs(p[i]), 0.01)
                assert f(q) > -r.ll - 1e-6, (r.model, i)


def test_paths_come_from_the_converged_fit(spark, rows, monkeypatch):
    seen, paths = [], models.simulate.garch_paths
    monkeypatch.setattr(models.simulate, "garch_paths", lambda fits, *a: seen.append(fits.first()) or paths(fits, *a))
    assert models.garch_paths(spark, "").count() > 0
    p, _, converged = volatility.fit_series(rows, "garch")
    assert converged and np.allclose([seen[0].omega, seen[0].alpha, seen[0].beta], p)


def test_a_cut_fit_says_so(rows):
    assert not volatility.fit_series(rows, "gjr", 5)[2]
