import numpy as np

from tidewater.operators import regimes
from tidewater.plans import models


def table(spark, n=290):
    x = np.random.default_rng(5).normal(0, 1, n) * np.where(np.arange(n) < 200, 1.0, 3.0)
    return x, spark.createDataFrame([("X", i + 1, float(v)) for i, v in enumerate(x)], "ticker string, idx long, g double").coalesce(1)


def test_every_step_has_a_regime(spark):
    x, rows = table(spark)
    got = {r.idx: r.state for r in regimes.walk_forward(rows, 250, 1, 2).collect()}
    assert sorted(got) == list(range(250, 291))
    for end, state in got.items():
        w = x[end - 250 : end]
        m = {**regimes.fit(w, "normal", 2, 30), "family": "normal", "k": 2}
        assert state == regimes.viterbi(regimes._log_b(w, m), m["trans"])[-1] + 1


def test_queries_fit_with_the_operators_rounds(spark, monkeypatch):
    x, rows = table(spark)
    monkeypatch.setattr(models, "_scaled", lambda *_: rows)
    want = {(f, k): regimes.fit(x, f, k, 30) for f in ("normal", "t", "laplace", "ged") for k in (2, 3)}
    assert any(len(m["ll_history"]) > 15 for m in want.values())
    for r in models.hmm_fits(spark, "").collect():
        assert np.allclose(r.ll_history, want[r.family, r.k]["ll_history"])
