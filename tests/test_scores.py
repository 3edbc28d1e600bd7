"""Scores and special functions against plain NumPy, with blocks, tiles and segments small enough to matter."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import dists, special
from tidewater.operators import linear, logsums, pooled, resampling, signatures, sojourn, stats, tiles


def value(spark, expression):
    return spark.range(1).select(F.expr(expression)).first()[0]


@pytest.mark.parametrize("x", [0.01, 0.3, 1.0, 2.5, 9.0, 150.25])
def test_lgamma(spark, x):
    assert math.isclose(value(spark, special.lgamma(f"{x}D")), math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("x", [-8.0, -3.1, -0.4, 0.0, 0.7, 2.2, 6.9])
def test_distribution_functions(spark, x):
    assert math.isclose(value(spark, special.normal_cdf(f"{x}D")), 0.5 * math.erfc(-x / math.sqrt(2)), abs_tol=1e-14)
    for nu in (1.0, 2.0, 5.0, 8.0, 4.3):
        steps = np.linspace(0, abs(x), 200_001)
        f = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi * nu) * (1 + steps**2 / nu) ** (-(nu + 1) / 2)
        half = float(np.trapezoid(f, steps))
        assert math.isclose(value(spark, special.t_cdf(f"{x}D", nu)), 0.5 + math.copysign(half, x), abs_tol=1e-7), nu


def test_quantiles_invert(spark):
    for p in (0.0001, 0.05, 0.9):
        assert math.isclose(value(spark, special.normal_cdf(f"{dists.quantile('normal', p, 0.0)!r}D")), p, rel_tol=1e-6)
        assert math.isclose(value(spark, special.t_cdf(f"{dists.quantile('t', p, 5.0)!r}D", 5.0)), p, rel_tol=1e-6)


def test_anderson_darling_is_standard_under_the_null(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"ticker": "X", "path_id": np.repeat(np.arange(300), 60), "g": rng.normal(size=18_000)})
    seen = pd.DataFrame({"ticker": "X", "g": np.round(rng.normal(size=400), 1)})
    # a path against draws of its own distribution: the observed sample is another for every ticker
    many = spark.createDataFrame(rows.assign(ticker=rows.path_id.map(str)))
    other = spark.createDataFrame(pd.DataFrame({"ticker": np.repeat(np.arange(300), 90).astype(str), "g": rng.normal(size=27_000)}))
    got = pooled.anderson_darling(pooled.rank_statistics(pooled.pooled_counts(many, other))).toPandas()
    assert len(got) == 300 and abs(got.z.mean()) < 0.2 and 0.7 < got.z.std() < 1.3 and 0.01 < (got.p <= 0.05).mean() < 0.1
    far = pooled.anderson_darling(pooled.rank_statistics(pooled.pooled_counts(spark.createDataFrame(rows.assign(g=rows.g + 2)), spark.createDataFrame(seen)))).toPandas()
    assert (far.p < 0.01).all()
    same = spark.createDataFrame([("X", 1, 2.0)] * 3, "ticker string, path_id long, g double")
    assert pooled.anderson_darling(pooled.rank_statistics(pooled.pooled_counts(same, same.select("ticker", "g")))).first().p is None


@pytest.mark.parametrize("tile", [3, 7, 1000])
def test_tiles_equal_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    v = {0: rng.normal(size=(13, 4)).round(1), 1: rng.normal(size=(8, 4)).round(1)}
    v[0][3] = v[0][4]
    rows = spark.createDataFrame([("X", s, i, x.tolist()) for s in v for i, x in enumerate(v[s])], "ticker string, side int, id long, v array<double>")
    all_ = np.concatenate([v[0], v[1]])
    d = ((all_[:, None] - all_[None]) ** 2).sum(-1)
    median = float(np.median([d[i, j] for i, j in itertools.combinations(range(21), 2)]))
    band = tiles.median_distance(rows, tile)
    assert band.first().bandwidth == pytest.approx(median, rel=1e-15)
    k = np.exp(-d / median)
    sums = [(k[a, b].sum() - (np.trace(k[a, b]) if a == b else 0)) for a, b in ((slice(0, 13), slice(0, 13)), (slice(13, 21), slice(13, 21)), (slice(0, 13), slice(13, 21)))]
    want = max(0.0, sums[0] / (13 * 12) + sums[1] / (8 * 7) - 2 * sums[2] / (13 * 8))
    assert tiles.mmd2(rows, band, tile).first().mmd2 == pytest.approx(want, abs=1e-12)
    assert tiles.median_distance(rows.where("id = 0 and side = 0"), tile).first().bandwidth == 1.0


@pytest.mark.parametrize("n", [2, 5, 40, 700])
def test_signature(spark, n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    inc = np.column_stack([np.full(n - 1, 1 / (n - 1)), np.diff(x) / x.std(ddof=1)])
    s1, s2, s3 = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2, 2))
    for d in inc:
        s3 += np.multiply.outer(s2, d)
        s2 += np.multiply.outer(s1, d)
        s1 += d
    want = np.concatenate([s1, s2.ravel(order="F"), s3.ravel(order="F")])
    rows = spark.createDataFrame([("X", 1, i + 1, float(g)) for i, g in enumerate(x)] + [("Y", 1, 1, 5.0)], "ticker string, window long, pos long, g double")
    got = {r.ticker: r.s for r in signatures.signatures(rows, 3, 8).collect()}
    assert np.allclose(got["X"], want, rtol=1e-9, atol=1e-12) and got["Y"] == [0.0] * 14


def test_least_squares(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3)) * [1, 1000, 0.001]
    y = x @ [1.5, -0.002, 30.0] + rng.normal(size=200)
    rows = spark.createDataFrame([("X", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [("Z", 1.0, 1.0, 1.0, 2.0)] * 5, "ticker string, a double, b double, c double, y double")
    got = {r.ticker: r for r in linear.least_squares(rows, ["ticker"], [F.lit(1.0), *map(F.col, "abc")], F.col("y")).collect()}
    assert np.allclose(got["X"].beta, np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0], rtol=1e-8)
    assert got["Z"].n == 5 and None in got["Z"].beta


def test_resamples_equal_copied_series(spark):
    x = np.random.default_rng(3).normal(size=97).round(1)
    rows = spark.createDataFrame([("X", i + 1, float(g)) for i, g in enumerate(x)], "ticker string, idx long, g double")
    found = resampling.blocks(rows, 12, 200.0).unionByName(resampling.blocks(rows, 12, 4.0).withColumn("b", F.col("b") + 100))
    copies = {}
    for r in found.collect():
        copies.setdefault(r.b, []).extend(x[(r.start + i) % 97] for i in range(r.length))
    kurt = {r.b: r.kurt for r in resampling.resampled_kurtosis(rows, found).collect()}
    ks = {r.b: r.ks for r in resampling.resampled_ks(rows, found).collect()}
    assert len(copies) == len(kurt) == len(ks) == 24
    for b, c in copies.items():
        c = np.array(c)
        assert len(c) == 97
        assert kurt[b] == pytest.approx((((c - c.mean()) / c.std(ddof=1)) ** 4).mean() - 3, abs=1e-9)
        at = np.unique(x)
        assert ks[b] == pytest.approx(np.abs([(c <= v).mean() - (x <= v).mean() for v in at]).max(), abs=1e-12)


def test_log_sums_and_sojourns(spark):
    x = [-1e5, 3.0, float("-inf"), 800.0, 799.0] * 60
    rows = spark.createDataFrame([("X", i + 1, v) for i, v in enumerate(x)] + [("Y", 1, float("-inf"))], "ticker string, idx long, g double")
    got = {r.ticker: r.lse for r in logsums.log_sum_exp(rows, size=4).collect()}
    assert got["X"] == pytest.approx(800 + math.log(60 * (1 + math.exp(-1)))) and got["Y"] == float("-inf")
    runs = spark.createDataFrame([("X", 1, n) for n in [1] * 40 + [2] * 9 + [30, 60]] + [("X", 2, 3), ("X", 2, 4)], "ticker string, state int, length long")
    fits = {r.state: r for r in sojourn.sojourn_families(runs).collect()}
    assert fits[1].family == "pareto" and fits[2].family == "nb"
    table = sojourn.pareto_table(sojourn.sojourn_families(runs)).where("state = 1").orderBy("d").collect()
    assert table[0].d == 1 and table[-1].d == 120 and table[-1].cdf == pytest.approx(1)


def test_signature_discrepancy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(14, 6)) * np.where(np.arange(14) < 8, 1.0, 1.7)[:, None]
    rows = [("A", i, j + 1, float(x)) for i in range(14) for j, x in enumerate(v[i])]
    sides = [spark.createDataFrame([r for r in rows if (r[1] < 8) == (s == 0)], "ticker string, window long, pos long, g double") for s in (0, 1)]
    got = signatures.vectors(sides[0], 0).unionByName(signatures.vectors(sides[1], 1))
    row = tiles.mmd2(got, tiles.median_distance(got, tile=3), tile=3).first()
    assert row["n"] == 8 and row["m"] == 6
    plain = np.array([r["v"] for r in got.orderBy("side", "id").collect()])
    d = ((plain[:, None] - plain[None]) ** 2).sum(-1)
    k = np.exp(-d / np.median(d[np.triu_indices(14, 1)]))
    own = lambda a: (a.sum() - np.trace(a)) / (len(a) * (len(a) - 1))
    assert math.isclose(row["mmd2"], max(0.0, own(k[:8, :8]) + own(k[8:, 8:]) - 2 * k[:8, 8:].mean()), abs_tol=1e-12)


def test_generator_paths(spark):
    rng = np.random.default_rng(5)
    rows = [("A", i + 1, float(rng.normal()), i < 25) for i in range(40)] + [("B", 1, 0.5, False), ("C", 1, 0.25, True)]
    frame = spark.createDataFrame(rows, "ticker string, idx long, g double, first boolean")
    made = resampling.generator_paths(frame, F.col("first"), 6)
    held = {name: {(r["ticker"], r["path_id"], r["t"]): r["g"] for r in paths.collect()} for name, paths, _ in made}
    own, other = [r[2] for r in rows[:25]], [r[2] for r in rows[25:40]]
    assert {k[0] for k in held["later"]} == {"A", "B"} and {k[0] for k in held["earlier"]} == {k[0] for k in held["normal"]} == {"A"}
    assert len(held["earlier"]) == 6 * 15 and len(held["normal"]) == 6 * 25 and len(held["later"]) == 6 * 16
    assert {v for k, v in held["later"].items() if k[0] == "A"} <= set(other) and set(held["earlier"].values()) <= set(own)
    got = {(r["ticker"], r["generator"]): r for r in pooled.pass_rates(made).collect()}
    assert set(got) == {("A", "later"), ("B", "later"), ("A", "earlier"), ("A", "normal")}
    for name, against in (("later", other), ("earlier", other), ("normal", own)):
        gaps = []
        for p in range(1, 7):
            path = [v for k, v in held[name].items() if k[0] == "A" and k[1] == p]
            gaps.append(max(abs(np.mean(np.array(path) <= x) - np.mean(np.array(against) <= x)) for x in path + against))
        assert math.isclose(got["A", name]["mean_ks"], float(np.mean(gaps)), rel_tol=1e-12)
    assert got["B", "later"]["mean_ks"] == 0 and got["B", "later"]["pass_rate"] == 1


def test_weighted_median_by_stretches(spark):
    """A key's rows are dealt to many stretches; results are those of a plain pass over each key's rows in order."""
    rng = np.random.default_rng(8)
    rows = [("a", float(rng.integers(40)), float(rng.integers(0, 9))) for _ in range(400)] + [(None, float(x), float(rng.random())) for x in rng.normal(size=300)]
    rows += [("b", float(rng.integers(30)), float(rng.integers(-3, 6))) for _ in range(200)] + [("none", float(x), 0.0) for x in (5, 1, 2, 8)] + [("null", float(x), None) for x in (4, 9, 1)]
    rows += [("one", 2.5, 3.0), ("a", None, 50.0), ("late", 1.0, None), ("late", 2.0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, x double, w double")

    def plain(key):
        own = sorted((x, w or 0.0) for k, x, w in rows if k == key and x is not None)
        total = sum(w for _, w in own)
        if not total > 0:
            return float(np.median([x for x, _ in own]))
        return min(x for x, _ in own if sum(w for y, w in own if y <= x) >= total / 2)

    for halvings in (1, 4, stats.HALVINGS):
        got = stats.weighted_median(frame, "k", "x", "w", halvings)
        assert got.columns == ["k", "weighted_median"]
        assert {r["k"]: r["weighted_median"] for r in got.collect()} == {k: plain(k) for k in ("a", "b", None, "none", "null", "one", "late")}
    plan = stats.weighted_median(frame, "k", "x", "w")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and not any("w_upto" in x and "windowspecdefinition(k" in x and "stretch" not in x for x in plan.splitlines())
    assert stats.weighted_median(frame.limit(0), "k", "x", "w").collect() == []
