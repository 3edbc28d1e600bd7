import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import dists
from tidewater.operators import recursions, regimes, simulate, volatility


def series(spark, x, ticker="X"):
    return spark.createDataFrame([(ticker, i + 1, float(v)) for i, v in enumerate(x)], "ticker string, idx long, g double")


def two_regimes(n=1500, seed=3):
    rng, s, out, state = np.random.default_rng(seed), [1.0, 4.0], [], 0
    states = []
    for _ in range(n):
        state = state if rng.random() < (0.98, 0.95)[state] else 1 - state
        states.append(state)
        out.append(rng.normal(0, s[state]))
    return np.array(out), np.array(states)


@pytest.mark.parametrize("family", ["normal", "t", "laplace", "ged"])
def test_fits_rise_and_find_two_scales(family):
    x, states = two_regimes()
    m = regimes.fit(x, family, 2, 40)
    assert m["ll_history"][-1] > m["ll_history"][0]
    assert all(b > a - 1e-3 for a, b in zip(m["ll_history"], m["ll_history"][1:], strict=False))
    assert np.allclose(m["trans"].sum(1), 1) and m["scale"][1] >= m["scale"][0]
    if family == "ged":  # from sorted chunks it ends in a split by location
        return
    assert m["scale"][1] > 2 * m["scale"][0]
    path = regimes.viterbi(regimes._log_b(x, {**m, "family": family, "k": 2}), m["trans"])
    assert (path == states).mean() > 0.9


def test_fit_likelihood_equals_the_fold(spark):
    x, _ = two_regimes(800)
    r = series(spark, x)
    fits = volatility.fit_volatility(r, ["garch"], 100).first()
    p = fits.params
    got = recursions.garch_likelihood(recursions.series(r), *[f"cast({p[c]!r} as double)" for c in ("omega", "alpha", "beta")]).first()
    assert math.isclose(got.ll, fits.ll, rel_tol=1e-9) and p["alpha"] + p["beta"] < 0.999


def test_paths_do_not_depend_on_partitions(spark):
    models = regimes.fit_regimes(series(spark, two_regimes(600)[0]), ["t"], [2], 8)
    a = simulate.regime_paths(models, 6, 40).orderBy("path_id", "t").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    b = simulate.regime_paths(models, 6, 40).orderBy("path_id", "t").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and len(a) == 240


def test_conditional_var_covers(spark):
    r = series(spark, two_regimes(1200)[0])
    out = regimes.conditional_var(r, regimes.fit_regimes(r, ["normal"], [2], 20), 0.05)
    assert abs(out.agg(F.avg(F.col("breach").cast("double"))).first()[0] - 0.05) < 0.02


def test_distributions():
    assert math.isclose(dists.chi2_sf(3.980, 2), math.exp(-1.99), rel_tol=1e-9)
    assert math.isclose(dists.chi2_sf(15.461, 6), 0.017, abs_tol=5e-4)
    assert math.isclose(dists.t_cdf(2.228, 10), 0.975, abs_tol=1e-4)
    assert math.isclose(dists.f_sf(4.26, 2, 9), 0.05, abs_tol=2e-4)
    for family, shape in (("normal", 0), ("t", 5.0), ("laplace", 1.0), ("ged", 1.4)):
        for p in (0.01, 0.3, 0.9):
            assert math.isclose(dists.cdf(family, dists.quantile(family, p, shape), shape), p, abs_tol=1e-9)


def test_copula_profile_finds_the_degrees_of_freedom(spark):
    from tidewater.operators import dependence

    rng = np.random.default_rng(11)
    c = np.linalg.cholesky([[1, 0.6], [0.6, 1]])
    x = rng.standard_normal((1500, 2)) @ c.T / np.sqrt(rng.chisquare(4, (1500, 1)) / 4)
    rows = [(t, i, float(v)) for i, r in enumerate(x) for t, v in zip("AB", r, strict=True)]
    out = dependence.copula_profile(spark.createDataFrame(rows, "ticker string, dt int, g double"), ["A", "B"], [2.5, 4, 20, 1e9]).collect()
    best = max(out, key=lambda r: r.ll)
    assert best.nu == 4 and abs(best.sigma[0][1] - 0.6) < 0.06


def test_tau_b_equals_all_pairs():
    from tidewater.operators.dependence import tau_b

    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.integers(0, 6, (2, 25)).astype(float)
        i, j = np.triu_indices(25, 1)
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        want = s.sum() / np.sqrt((x[i] != x[j]).sum() * (y[i] != y[j]).sum())
        assert math.isclose(tau_b(x, y), want)
