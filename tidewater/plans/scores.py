"""Queries of scans over segments and of scores between samples, windows and paths, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import dists, special
from tidewater.operators import likelihoods, linear, logsums, mixture, pooled, resampling, risk, scans, signatures, sojourn, stats, tiles, timeseries, windowing
from tidewater.plans.panel import BINS_SQL, RETURNS_SQL, returns, rounded
from tidewater.plans.reports import _KS_SQL, MOVE, SIGMA, _acf_error_sql, _paths, _scaled
from tidewater.plans.validation import _boot, _uniform

#: Degrees of freedom of the t mixture, the normal's 5 % quantile, shapes of the generalised error distributions.
NU, NORMAL_05, SHAPES = 5.0, -1.6448536269514722, (1.0, 1.3, 2.0)
#: Parameters of the filters with two and three regimes: (omega, alpha, beta), moves, mean.
REGIMES = {
    2: ([0.05, 0.4], [0.05, 0.1], [0.85, 0.8], [[0.97, 0.03], [0.06, 0.94]], 0.01),
    3: ([0.02, 0.1, 0.6], [0.03, 0.06, 0.12], [0.9, 0.85, 0.7], [[0.95, 0.04, 0.01], [0.03, 0.94, 0.03], [0.02, 0.06, 0.92]], 0.01),
}


def _hamilton(spark, sf_dir, k: int):
    rows = scans.hamilton_filter(_scaled(spark, sf_dir), *REGIMES[k][:3], REGIMES[k][4], REGIMES[k][3])
    return rounded(rows.select("ticker", "idx", *[F.col("s2")[i].alias(f"s2_{i + 1}") for i in range(k)], *[F.col("p")[i].alias(f"p_{i + 1}") for i in range(k)], "ll"))


def hamilton_filter(spark, sf_dir):
    """Variances, state probabilities and log density of every step under two GARCH regimes."""
    return _hamilton(spark, sf_dir, 2)


def hamilton_filter_three(spark, sf_dir):
    return _hamilton(spark, sf_dir, 3)


def predictive_states(spark, sf_dir):
    """State predictions before every step and after the last."""
    rows = scans.predictive(likelihoods.filtered_states(_scaled(spark, sf_dir), MOVE, SIGMA), MOVE)
    return rounded(rows.select("ticker", "idx", *[F.col("pred")[i].alias(f"p_{i + 1}") for i in range(3)]))


def path_anderson_darling(spark, sf_dir):
    """Anderson-Darling statistic of every path against its ticker's series, standardised, with its tail probability."""
    got = pooled.anderson_darling(pooled.rank_statistics(pooled.pooled_counts(_paths(spark, sf_dir), returns(spark, sf_dir))))
    return rounded(got.select("ticker", "path_id", "n", "m", "ks", "a2", "z", "p"), 5)


def path_ad_pass(spark, sf_dir):
    got = pooled.anderson_darling(pooled.rank_statistics(pooled.pooled_counts(_paths(spark, sf_dir), returns(spark, sf_dir))))
    passed = F.coalesce(F.col("p") > 0.05, F.lit(False)).cast("double")
    return rounded(got.groupBy("ticker").agg(F.count("*").alias("paths"), F.avg("z").alias("mean_z"), F.avg(passed).alias("pass_rate")), 5)


def path_panel(spark, sf_dir):
    """Rank tests, distances, kurtosis, clustering and coverage of all paths of a ticker."""
    return rounded(pooled.path_panel(_paths(spark, sf_dir), returns(spark, sf_dir), 5), 5)


def _archive(spark, sf_dir):
    return tiles.archive_windows(_paths(spark, sf_dir), 20, 100, 20, 50)


def archive_windows(spark, sf_dir):
    """Windows of 20 steps drawn from the paths."""
    return rounded(_archive(spark, sf_dir))


def _window_vectors(spark, sf_dir):
    seen = windowing.windowize(_scaled(spark, sf_dir), 20, 15)
    drawn = _archive(spark, sf_dir).withColumn("g", F.col("g") / 100)
    return tiles.vectors(seen, 0).unionByName(tiles.vectors(drawn, 1))


def median_bandwidth(spark, sf_dir):
    """Median squared distance of all pairs of windows, observed and drawn."""
    return rounded(tiles.median_distance(_window_vectors(spark, sf_dir)))


def window_mmd(spark, sf_dir):
    """Squared maximum mean discrepancy of observed and drawn windows at the median bandwidth."""
    rows = _window_vectors(spark, sf_dir)
    return rounded(tiles.mmd2(rows, tiles.median_distance(rows)))


def signature_mmd(spark, sf_dir):
    """Discrepancy of the signatures of observed and drawn windows at their median bandwidth."""
    seen = windowing.windowize(_scaled(spark, sf_dir), 20, 15)
    drawn = _archive(spark, sf_dir).withColumn("g", F.col("g") / 100)
    rows = signatures.vectors(seen, 0).unionByName(signatures.vectors(drawn, 1))
    return rounded(tiles.mmd2(rows, tiles.median_distance(rows)))


def ks_power(spark, sf_dir):
    """How often the Kolmogorov-Smirnov test passes paths of a right, a nearly right and a wrong generator."""
    got = resampling.generator_paths(returns(spark, sf_dir), F.col("dt") < F.lit("1996-01-01").cast("date"), POWER_PATHS)
    return rounded(pooled.pass_rates(got))


def window_signatures(spark, sf_dir):
    """Signatures to depth 3 of every observed window."""
    got = signatures.signatures(windowing.windowize(_scaled(spark, sf_dir), 20, 15))
    return rounded(got.select("ticker", "window", *[F.col("s")[i].alias(f"s{i + 1:02d}") for i in range(14)]))


def series_signature(spark, sf_dir):
    """Signature to depth 3 of every whole series: segments multiplied in parallel."""
    whole = _scaled(spark, sf_dir).select("ticker", F.lit(1).cast("long").alias("window"), F.col("idx").alias("pos"), "g")
    return rounded(signatures.signatures(whole).select("ticker", "n", *[F.col("s")[i].alias(f"s{i + 1:02d}") for i in range(14)]))


def har_fit(spark, sf_dir):
    """Coefficients of the log squared return on a constant and the logs of its day, week and month means."""
    rows = timeseries.har_features(_scaled(spark, sf_dir)).where("rv > 0 and rv_d > 0")
    got = linear.least_squares(rows, ["ticker"], [F.lit(1.0), *[F.log(c) for c in ("rv_d", "rv_w", "rv_m")]], F.log("rv"))
    return rounded(got.select("ticker", "n", *[F.col("beta")[i].alias(c) for i, c in enumerate(("b0", "b_d", "b_w", "b_m"))]))


def dynamic_quantile(spark, sf_dir):
    return rounded(linear.dynamic_quantile(risk.rolling_breaches(_scaled(spark, sf_dir), 0.05, 250), 0.05), 5)


def har_synthetic(spark, sf_dir):
    """Forecasts of the later squared returns by coefficients of the earlier ones, and by those of simulated paths."""
    rows = _scaled(spark, sf_dir)
    early, late = (linear.har_levels(rows.where(w)) for w in ("dt < date'1996-01-01'", "dt >= date'1996-01-01'"))
    made = linear.har_levels(linear.pooled_series(_paths(spark, sf_dir).withColumn("g", F.col("g") / 100), 20, 50))
    got = [linear.har_scores(late, linear.har_coefficients(f)).withColumn("trained_on", F.lit(name)) for f, name in ((early, "real"), (made, "synthetic"))]
    return rounded(got[0].unionByName(got[1]), 5)


RESAMPLES, LENGTHS = 20, (5, 10, 20)
#: Paths a generator of the power calibration.
POWER_PATHS = 40


def bootstrap_kurtosis(spark, sf_dir):
    """Median and 95 % interval of the excess kurtosis over stationary block resamples, by mean block length."""
    r = returns(spark, sf_dir)
    found = [resampling.interval(resampling.resampled_kurtosis(r, resampling.blocks(r, RESAMPLES, n)), "kurt", (0.025, 0.5, 0.975)).withColumn("mean_length", F.lit(n)) for n in LENGTHS]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), 4)


def bootstrap_ks_critical(spark, sf_dir):
    """95 % quantile of the distance of stationary block resamples to their series, by mean block length."""
    r = returns(spark, sf_dir)
    found = [resampling.interval(resampling.resampled_ks(r, resampling.blocks(r, RESAMPLES, n)), "ks", (0.5, 0.95)).withColumn("mean_length", F.lit(n)) for n in LENGTHS]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]))


def _runs(spark, sf_dir):
    return stats.state_runs(stats.ordinal_bins(returns(spark, sf_dir), 5)).withColumnRenamed("bin", "state")


def sojourn_families(spark, sf_dir):
    """Negative binomial or truncated Pareto for the stays in each state, by likelihood."""
    return rounded(sojourn.sojourn_families(_runs(spark, sf_dir)), 5)


def pareto_table(spark, sf_dir):
    return rounded(sojourn.pareto_table(sojourn.sojourn_families(_runs(spark, sf_dir))))


def ged_deviations(spark, sf_dir):
    """Deviation implied by the likeliest scale of a generalised error distribution around 0, for three shapes."""
    rows = _scaled(spark, sf_dir).withColumn("shape", F.explode(F.array(*[F.lit(p) for p in SHAPES])))
    fits = rows.groupBy("ticker", "shape").agg(F.pow(F.first("shape") * F.avg(F.pow(F.abs("g"), F.col("shape"))), 1 / F.first("shape")).alias("scale"))
    return rounded(fits.withColumn("deviation", F.expr(special.ged_deviation("scale", "shape"))))


def log_sum_exp(spark, sf_dir):
    return rounded(logsums.log_sum_exp(returns(spark, sf_dir)))


def rolling_log_sum_exp(spark, sf_dir):
    return rounded(logsums.rolling_log_sum_exp(returns(spark, sf_dir), 20))


def _grid(family: str) -> tuple[float, float]:
    """Ends of the grid: the least and largest quantile of any state at 0.0001 and 0.9999."""
    q = dists.quantile(family, 0.9999, NU) * max(SIGMA)
    return -q, q


def _mixture_var(spark, sf_dir, family: str):
    low, high = _grid(family)
    cdf = {"normal": special.normal_cdf, "t": lambda x: special.t_cdf(x, NU)}[family]
    rows = likelihoods.filtered_states(_scaled(spark, sf_dir), MOVE, SIGMA)
    got = mixture.grid_var(rows, "pred", [lambda x, s=s: cdf(f"({x} / {s!r}D)") for s in SIGMA], low, high, 0.05)
    return rounded(got.select("ticker", "idx", "var", (F.col("x") < F.col("var")).alias("breach")))


def mixture_var_normal(spark, sf_dir):
    """5 % value at risk of every step under its predicted mixture of normal states."""
    return _mixture_var(spark, sf_dir, "normal")


def mixture_var_t(spark, sf_dir):
    return _mixture_var(spark, sf_dir, "t")


def decoded_state_var(spark, sf_dir):
    """5 % value at risk of the decoded state, from its autoregression and from its still distribution."""
    return rounded(mixture.decoded_state_var(stats.ordinal_bins(returns(spark, sf_dir), 5), NORMAL_05), 5)


def _walked(k: int, variances: bool) -> str:
    """Recursive rows f of a filter: predictions q, probabilities p, with variances of their own (s) or fixed ones."""
    omega, alpha, beta, move, mu = REGIMES[k] if variances else ([], [], [], MOVE, 0.0)
    n = range(1, k + 1)
    prior = scans.stationary(move) if variances else [1 / k] * k
    s = {j: f"s{j}" if variances else f"{SIGMA[j - 1] ** 2!r}::DOUBLE" for j in n}
    density = {j: f"exp(-0.5 * (x - {mu}::DOUBLE) ** 2 / {s[j]}) / sqrt(2 * pi() * {s[j]})" for j in n}
    start = ", ".join([f"CAST({prior[j - 1]!r} AS DOUBLE) AS q{j}" for j in n] + [f"CAST({omega[j - 1] / (1 - alpha[j - 1] - beta[j - 1])!r} AS DOUBLE) AS s{j}" for j in n if variances])
    joint = ", ".join(f"q{j} * {density[j]} AS u{j}" for j in n)
    total = "(" + " + ".join(f"u{j}" for j in n) + ")"
    ahead = ", ".join("({}) / {}".format(" + ".join(f"u{i} * {move[i - 1][j - 1]}::DOUBLE" for i in n), total) for j in n)
    grown = "".join(f", greatest({omega[j - 1]}::DOUBLE + {alpha[j - 1]}::DOUBLE * (x - {mu}::DOUBLE) ** 2 + {beta[j - 1]}::DOUBLE * s{j}, 1e-12)" for j in n if variances)
    return f"""WITH RECURSIVE {RETURNS_SQL}, v AS (SELECT ticker, idx, g / 100 AS x FROM returns), f AS (
SELECT DISTINCT ticker, CAST(1 AS BIGINT) AS idx, {start} FROM v UNION ALL SELECT ticker, idx + 1, {ahead}{grown} FROM (SELECT f.*, x, {joint} FROM f JOIN v USING (ticker, idx))),
told AS (SELECT f.*, x, {joint} FROM f JOIN v USING (ticker, idx))"""


def _hamilton_sql(k: int) -> str:
    n = range(1, k + 1)
    total = "(" + " + ".join(f"u{j}" for j in n) + ")"
    return f"{_walked(k, True)} SELECT ticker, idx, {', '.join(f'round(s{j}, 6) AS s2_{j}' for j in n)}, {', '.join(f'round(u{j} / {total}, 6) AS p_{j}' for j in n)}, round(ln({total}), 6) AS ll FROM told"


def _ad_sql() -> str:
    c2, c1, c0 = pooled.tail_fit()
    low, high = (pooled._B0[i] + pooled._B1[i] + pooled._B2[i] for i in (0, -1))
    return f"""WITH {_boot(20, 50)}, s AS (SELECT ticker, path_id, 0 AS side, g AS x FROM boot UNION ALL SELECT ticker, path_id, 1, g FROM (SELECT DISTINCT ticker, path_id FROM boot) JOIN returns USING (ticker)),
c AS (SELECT ticker, path_id, x, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM s GROUP BY 1, 2, 3),
up AS (SELECT *, sum(p) OVER o AS pu, sum(q) OVER o AS qu, sum(p) OVER w AS n, sum(q) OVER w AS m FROM c WINDOW w AS (PARTITION BY ticker, path_id), o AS (PARTITION BY ticker, path_id ORDER BY x)),
t AS (SELECT *, CAST(n + m AS DOUBLE) AS N2, p + q AS l, pu + qu - (p + q) / 2 AS b FROM up),
st AS (SELECT ticker, path_id, any_value(n) AS n, any_value(m) AS m, max(abs(pu / n - qu / m)) AS ks, (any_value(N2) - 1) / any_value(N2) * (1 / any_value(n) + 1 / any_value(m)) * sum(l / N2 * (N2 * (pu - p / 2) - n * b) ** 2 / (b * (N2 - b) - N2 * l / 4)) AS a2 FROM t GROUP BY 1, 2),
hs AS (SELECT i, sum(1 / CAST(i AS DOUBLE)) OVER (ORDER BY i) AS h FROM (SELECT unnest(range(1, CAST((SELECT max(n + m) FROM st) AS BIGINT))) AS i)),
sz AS (SELECT n, m, CAST(n + m AS DOUBLE) AS t, (SELECT h FROM hs WHERE i = n + m - 1) AS h, 1 / n + 1 / m AS f FROM (SELECT DISTINCT n, m FROM st)),
gs AS (SELECT n, m, any_value(t) AS t, any_value(sz.h) AS h, any_value(f) AS f, sum((sz.h - hs.h) / (t - i)) AS g FROM sz JOIN hs ON i <= t - 2 GROUP BY n, m),
vs AS (SELECT n, m, (((4 * g - 6) + (10 - 6 * g) * f) * t ** 3 + ((2 * g - 4) * 4 + 16 * h + (2 * g - 14 * h - 4) * f - 8 * h + 4 * g - 6) * t ** 2 + ((6 * h + 2 * g - 2) * 4 + (4 * h - 4 * g + 6) * 2 + (2 * h - 6) * f + 4 * h) * t + (2 * h + 6) * 4 - 8 * h) / ((t - 1) * (t - 2) * (t - 3)) AS v FROM gs),
z AS (SELECT st.*, (a2 - 1) / sqrt(v) AS z FROM st JOIN vs USING (n, m)),
ad AS (SELECT *, CASE WHEN z <= {low!r} THEN 0.25 WHEN z >= {high!r} THEN 0.001 ELSE exp({c2!r} * z * z + {c1!r} * z + {c0!r}) END AS p FROM z)"""


def _panel_sql() -> str:
    acf = _acf_error_sql("abs(g)").removeprefix("WITH ").partition("pa AS")[2]
    acf, _, last = ("pa AS" + acf).rpartition("\nSELECT ticker, round(a, 6)")
    probs = ", ".join(str(i / 100) for i in range(1, 100))
    return f"""{_ad_sql()}, b AS (SELECT ticker, path_id, t AS i, abs(g) AS g FROM boot), o AS (SELECT ticker, idx AS i, abs(g) AS g FROM returns), {acf},
kp AS (SELECT ticker, path_id, ks, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m FROM st), kr AS (SELECT ticker, avg(CASE WHEN {_KS_SQL} > 0.05 THEN 1.0 ELSE 0 END) AS ks_pass FROM kp GROUP BY ticker),
ar AS (SELECT ticker, count(*) AS paths, avg(CASE WHEN p > 0.05 THEN 1.0 ELSE 0 END) AS ad_pass FROM ad GROUP BY ticker),
br AS (SELECT ticker, path_id, g, row_number() OVER (PARTITION BY ticker, path_id ORDER BY g) AS r, count(*) OVER (PARTITION BY ticker, path_id) AS n FROM boot), rr AS (SELECT ticker, g, row_number() OVER (PARTITION BY ticker ORDER BY g) AS r, count(*) OVER (PARTITION BY ticker) AS m FROM returns),
sk AS (SELECT ticker, path_id, n, m, unnest(range(1, least(n, m) + 1)) AS k FROM (SELECT DISTINCT br.ticker, path_id, n, m FROM br JOIN rr USING (ticker))),
wp AS (SELECT sk.ticker, sk.path_id, avg(abs(br.g - rr.g)) AS w FROM sk JOIN br ON br.ticker = sk.ticker AND br.path_id = sk.path_id AND br.r = round_even(k * sk.n / least(sk.n, sk.m), 0) JOIN rr ON rr.ticker = sk.ticker AND rr.r = round_even(k * sk.m / least(sk.n, sk.m), 0) GROUP BY 1, 2),
he AS (SELECT *, min(x) OVER w - 10 AS lo, max(x) OVER w + 10 AS hi FROM t WINDOW w AS (PARTITION BY ticker, path_id)), hb AS (SELECT ticker, path_id, least(floor((x - lo) / ((hi - lo) / 100)), 99) AS bucket, sum(p) / any_value(n) AS a, sum(q) / any_value(m) AS c FROM he GROUP BY ALL),
hp AS (SELECT ticker, path_id, sqrt(sum((sqrt(a) - sqrt(c)) ** 2) / 2) AS h FROM hb GROUP BY 1, 2),
ku AS (SELECT ticker, path_id, (kurtosis_pop(g) + 3) * ((count(*) - 1) / count(*)::DOUBLE) ** 2 - 3 AS k FROM boot GROUP BY 1, 2),
qi AS (SELECT unnest(range(1, 100)) AS i), qp AS (SELECT ticker, path_id, quantile_cont(g, [{probs}]) AS q FROM boot GROUP BY 1, 2), qb AS (SELECT ticker, i, quantile_cont(q[i], 0.05) AS lo, quantile_cont(q[i], 0.95) AS hi FROM qp, qi GROUP BY 1, 2), qo AS (SELECT ticker, quantile_cont(g, [{probs}]) AS q FROM returns GROUP BY ticker),
co AS (SELECT ticker, avg(CASE WHEN q[i] BETWEEN lo AND hi THEN 1.0 ELSE 0 END) AS coverage FROM qb JOIN qo USING (ticker) GROUP BY ticker)
SELECT ticker, paths, round(ks_pass, 5) AS ks_pass, round(ad_pass, 5) AS ad_pass, round((SELECT avg(w) FROM wp WHERE wp.ticker = ar.ticker), 5) AS w1, round((SELECT avg(h) FROM hp WHERE hp.ticker = ar.ticker), 5) AS hellinger, round((SELECT avg(k) FROM ku WHERE ku.ticker = ar.ticker), 5) AS kurtosis, round((SELECT avg(e) FROM e WHERE e.ticker = ar.ticker), 5) AS acf_mae, round(coverage, 5) AS coverage FROM ar JOIN kr USING (ticker) JOIN co USING (ticker)"""


_SEEN = "seen AS (SELECT ticker, w + 1 AS id, idx - 15 * w AS pos, g / 100 AS g FROM (SELECT ticker, unnest(range(0, (n - 20) // 15 + 1)) AS w FROM (SELECT ticker, count(*) AS n FROM returns GROUP BY ticker HAVING count(*) >= 20)) JOIN returns USING (ticker) WHERE idx BETWEEN 15 * w + 1 AND 15 * w + 20)"


def _drawn_sql() -> str:
    """Drawn windows, on top of the paths."""
    return f"""{_boot(20, 50)}, {_uniform(100, 2, "d_")}, draws AS (SELECT path_id AS id, CAST(floor(any_value(u) FILTER (t = 1) * 20) AS BIGINT) + 1 AS p, CAST(floor(any_value(u) FILTER (t = 2) * 31) AS BIGINT) + 1 AS s FROM d_u GROUP BY path_id),
drawn AS (SELECT ticker, id, t - s + 1 AS pos, g FROM draws JOIN boot ON path_id = p AND t BETWEEN s AND s + 19)"""


def _distances_sql(length: int) -> str:
    """Squared distances of all pairs of the vectors v, and their median."""
    return f"""pairs AS (SELECT a.ticker, a.side + b.side AS kind, list_sum(list_transform(range(1, {length + 1}), lambda i: (a.v[i] - b.v[i]) ** 2)) AS d FROM v a JOIN v b ON a.ticker = b.ticker AND (a.side, a.id) < (b.side, b.id)),
band AS (SELECT ticker, median(d) AS bandwidth FROM pairs GROUP BY ticker)"""


_VECTORS = f"""{_SEEN}, v AS (SELECT ticker, 0 AS side, id, list(g ORDER BY pos) AS v FROM seen GROUP BY ticker, id UNION ALL SELECT ticker, 1, id, list(g / 100 ORDER BY pos) FROM drawn GROUP BY ticker, id),
{_distances_sql(20)}"""
_DISCREPANCY = """sizes AS (SELECT ticker, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM v GROUP BY ticker),
k AS (SELECT ticker, kind, sum(exp(-d / bandwidth)) AS s FROM pairs JOIN band USING (ticker) GROUP BY 1, 2)
SELECT ticker, n, m, round(greatest(0, sum(CASE kind WHEN 0 THEN 2 * s / (n * (n - 1)) WHEN 2 THEN 2 * s / (m * (m - 1)) ELSE -2 * s / (n * m) END)), 6) AS mmd2 FROM sizes JOIN k USING (ticker) GROUP BY ticker, n, m"""


def _signature_sql(rows: str, key: str, first: str, vector: bool = False) -> str:
    """Iterated sums by running sums, as columns or as one list v. rows: key, pos, g, with n and the deviation sd of the key."""
    level2 = ", ".join(f"sum({i}0 * {j}) OVER o - {i}0 * {j} AS {i}{j}0, sum({i}0 * {j}) OVER w AS {i}{j}" for j in "tx" for i in "tx")
    ends = ["sum(t)", "sum(x)", *(f"any_value({i}{j})" for j in "tx" for i in "tx"), *(f"sum({i}{j}0 * {k})" for k in "tx" for j in "tx" for i in "tx")]
    return f"""i AS (SELECT *, 1 / CAST(n - 1 AS DOUBLE) AS t, (g - lag(g) OVER (PARTITION BY {key} ORDER BY pos)) / greatest(sd, 1e-12) AS x FROM {rows}),
l AS (SELECT *, sum(t) OVER o - t AS t0, sum(x) OVER o - x AS x0 FROM i WHERE x IS NOT NULL WINDOW o AS (PARTITION BY {key} ORDER BY pos)),
m AS (SELECT *, {level2} FROM l WINDOW o AS (PARTITION BY {key} ORDER BY pos), w AS (PARTITION BY {key}))
SELECT {first}, {f"[{', '.join(ends)}] AS v" if vector else ', '.join(f'round({e}, 6) AS s{n + 1:02d}' for n, e in enumerate(ends))} FROM m GROUP BY {key}"""


def _signature_mmd_sql() -> str:
    rows = "both_ AS (SELECT ticker, 0 AS side, id, pos, g FROM seen UNION ALL SELECT ticker, 1, id, pos, g / 100 FROM drawn), r AS (SELECT *, count(*) OVER w AS n, stddev_samp(g) OVER w AS sd FROM both_ WINDOW w AS (PARTITION BY ticker, side, id))"
    parts, _, last = _signature_sql("r", "ticker, side, id", "ticker, side, id", vector=True).rpartition("\nSELECT ")
    return f"WITH {_drawn_sql()}, {_SEEN}, {rows}, {parts}, v AS (SELECT {last}), {_distances_sql(14)}, {_DISCREPANCY}"


def _solved_sql(name: str, rows: str, features: list[str], y: str, key: str = "ticker") -> str:
    """CTEs of least squares: `name` has key, n, b0 and so on, and the moments c0 and so on. Every pivot row is taken from all others."""
    x, n = [*features, y], len(features)
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    parts = [f"{name}_0 AS (SELECT {key}, count(*) AS n, {', '.join(f'sum(({x[i]}) * ({x[j]})) AS m{i}_{j}' for i, j in cells)}, {', '.join(f'sum(({x[i]}) * ({y})) AS c{i}' for i in range(n))} FROM {rows} GROUP BY {key})"]
    for k in range(n):
        step = ", ".join(f"m{i}_{j}" if i == k else f"m{i}_{j} - m{k}_{j} * m{i}_{k} / m{k}_{k} AS m{i}_{j}" for i, j in cells)
        parts.append(f"{name}_{k + 1} AS (SELECT {key}, n, {step}, {', '.join(f'c{i}' for i in range(n))} FROM {name}_{k})")
    parts.append(f"{name} AS (SELECT {key}, n, {', '.join(f'm{i}_{n} / m{i}_{i} AS b{i}, c{i}' for i in range(n))} FROM {name}_{n})")
    return ", ".join(parts)


def _har_sql(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT ticker, row_number() OVER w AS step, g * g AS rv, lag(g * g) OVER w AS rv_d, avg(g * g) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rv_w, avg(g * g) OVER (w ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS rv_m FROM {rows} WINDOW w AS (PARTITION BY ticker ORDER BY idx)) WHERE step > 22)"""


_LEVELS = ["1.0::DOUBLE", "rv_d", "rv_w", "rv_m"]
_SCALED = "scaled AS (SELECT ticker, dt, idx, g / 100 AS g FROM returns)"


def _har_synthetic_sql() -> str:
    score = lambda name, label: f"SELECT ticker, '{label}' AS trained_on, count(*) AS n, sqrt(avg((f - rv) ** 2)) AS rmse, avg(greatest(rv, 1e-10) / f - ln(greatest(rv, 1e-10) / f) - 1) AS qlike FROM (SELECT ticker, rv, greatest(1e-10, b0 + b1 * rv_d + b2 * rv_w + b3 * rv_m) AS f FROM late JOIN {name} USING (ticker)) GROUP BY ticker"
    return f"""WITH {_boot(20, 50)}, {_SCALED}, e0 AS (SELECT * FROM scaled WHERE dt < DATE '1996-01-01'), l0 AS (SELECT * FROM scaled WHERE dt >= DATE '1996-01-01'), s0 AS (SELECT ticker, (path_id - 1) * 50 + t AS idx, g / 100 AS g FROM boot),
{_har_sql("early", "e0")}, {_har_sql("late", "l0")}, {_har_sql("made", "s0")}, {_solved_sql("real_fit", "early", _LEVELS, "rv")}, {_solved_sql("made_fit", "made", _LEVELS, "rv")},
rows_ AS ({score("real_fit", "real")} UNION ALL {score("made_fit", "synthetic")}) SELECT ticker, trained_on, n, round(rmse, 5) AS rmse, round(qlike, 5) AS qlike FROM rows_"""


def _dq_sql() -> str:
    fit = _solved_sql("fit", "h", ["1.0::DOUBLE", "h1", "h2", "h3", "h4", "var"], "hit")
    dq = " + ".join(f"b{i} * c{i}" for i in range(6))
    return f"""WITH {RETURNS_SQL}, {_SCALED}, q AS (SELECT ticker, idx, g, quantile_cont(g, 0.05) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS var FROM scaled),
b AS (SELECT ticker, idx, var, CAST(g < var AS INTEGER) - 0.05::DOUBLE AS hit FROM q WHERE idx > 250), l AS (SELECT *, {", ".join(f"lag(hit, {k}) OVER w AS h{k}" for k in range(1, 5))} FROM b WINDOW w AS (PARTITION BY ticker ORDER BY idx)), h AS (SELECT * FROM l WHERE h4 IS NOT NULL),
{fit}, d AS (SELECT ticker, n, ({dq}) / (0.05 * 0.95::DOUBLE) AS dq FROM fit) SELECT ticker, n, round(dq, 5) AS dq, round(exp(-dq / 2) * (1 + dq / 2 + dq * dq / 8), 5) AS p FROM d"""


def _hashed(p: str, t: str, seed: int) -> str:
    """SQL of hash_uniform."""
    m = 2147483647
    h = f"(({p}) * 1103515245 + ({t}) * 69069069 + {seed * 40692 + 12345}) % {m}"
    return f"list_transform([{h}], lambda h: (list_transform([list_transform([(h * h + h * 48271 + 7) % {m}], lambda k: (k * 16807 + ({t})) % {m})[1]], lambda k: (k * k + k * 69621 + 11) % {m})[1] + 0.5::DOUBLE) / {m}::DOUBLE)[1]"


def _resampled_sql(select: str) -> str:
    """Copied resamples, step by step; select: from boots (ticker, mean_length, b, g)."""
    return f"""WITH {RETURNS_SQL}, lens AS (SELECT unnest([{", ".join(map(str, LENGTHS))}]) AS mean_length), z AS (SELECT ticker, count(*) AS n FROM returns GROUP BY ticker),
bt AS (SELECT ticker, mean_length, n, b, unnest(range(1, n + 1)) AS t FROM (SELECT *, unnest(range(1, {RESAMPLES + 1})) AS b FROM z, lens)),
uu AS (SELECT *, CASE WHEN t = 1 OR {_hashed("b", "t", 2)} < 1 / CAST(mean_length AS DOUBLE) THEN t END AS begun, CAST(floor({_hashed("b", "t", 3)} * n) AS BIGINT) AS start FROM bt),
ff AS (SELECT ticker, mean_length, b, n, t, last_value(begun IGNORE NULLS) OVER w AS first, last_value(CASE WHEN begun IS NOT NULL THEN start END IGNORE NULLS) OVER w AS start FROM uu WINDOW w AS (PARTITION BY ticker, mean_length, b ORDER BY t)),
boots AS (SELECT ff.ticker, mean_length, b, r.g FROM ff JOIN returns r ON r.ticker = ff.ticker AND r.idx = 1 + (ff.start + t - ff.first) % n), {select}"""


_FITS = f"""{BINS_SQL}, ch AS (SELECT ticker, idx, bin, CASE WHEN bin = lag(bin) OVER (PARTITION BY ticker ORDER BY idx) THEN 0 ELSE 1 END AS new FROM binned), rn AS (SELECT ticker, bin AS state, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY idx) AS run FROM ch) GROUP BY ticker, run, bin),
mo AS (SELECT ticker, state, count(*) AS k, avg(length) AS m, var_samp(length) AS v, min(length) AS d_min, greatest(2 * max(length), 100) AS d_max, sum(ln(length)) - count(*) * ln(min(length)) AS gaps FROM rn GROUP BY 1, 2),
pm AS (SELECT ticker, state, k, d_min, d_max, CASE WHEN k >= 3 AND v > m THEN greatest(0.1, m * m / (v - m)) END AS r, CASE WHEN k >= 3 AND v > m THEN least(1 - 1e-6, greatest(1e-6, m / v)) ELSE 1 / greatest(m, 1) END AS p, least(5, greatest(0.3, CASE WHEN gaps > 1e-12 THEN k / gaps ELSE 1.5 END)) AS alpha FROM mo),
pz AS (SELECT *, ln(list_sum(list_transform(range(d_min, d_max + 1), lambda d: CAST(d AS DOUBLE) ** (-alpha - 1)))) AS ln_z FROM pm),
ll AS (SELECT ticker, state, sum(CASE WHEN r IS NULL THEN length * CASE WHEN p < 1 THEN ln(1 - p) ELSE CAST('-inf' AS DOUBLE) END + ln(p) ELSE lgamma(length + r) - lgamma(r) - lgamma(length + 1) + r * ln(p) + length * ln(1 - p) END) AS ll_nb, sum((-alpha - 1) * ln(length) - ln_z) AS ll_pareto FROM rn JOIN pz USING (ticker, state) GROUP BY 1, 2)"""


def _ks_power_sql() -> str:
    at = lambda seed, n: f"CAST(floor({_hashed('path_id', 't', seed)} * {n}) AS BIGINT) + 1"
    normal = f"mu + sd * sqrt(-2 * ln({_hashed('path_id', 't', 7)})) * cos(2 * pi() * {_hashed('path_id', 't', 8)})"
    return f"""WITH {RETURNS_SQL}, part AS (SELECT ticker, idx, g, dt < DATE '1996-01-01' AS early FROM returns),
z AS (SELECT ticker, count(*) FILTER (early) AS n_early, count(*) FILTER (NOT early) AS n_late, avg(g) FILTER (early) AS mu, stddev_samp(g) FILTER (early) AS sd FROM part GROUP BY ticker),
q AS (SELECT ticker, early, path_id, idx - CASE WHEN early THEN 0 ELSE n_early END AS t, n_early, n_late, mu, sd FROM part JOIN z USING (ticker), (SELECT unnest(range(1, {POWER_PATHS + 1})) AS path_id) x),
places AS (SELECT ticker, 'later' AS generator, path_id, n_early + {at(5, "n_late")} AS idx FROM q WHERE NOT early UNION ALL SELECT ticker, 'earlier', path_id, {at(6, "n_early")} FROM q WHERE NOT early AND n_early > 0),
made AS (SELECT ticker, generator, path_id, g FROM places JOIN part USING (ticker, idx) UNION ALL SELECT ticker, 'normal', path_id, {normal} FROM q WHERE early AND sd IS NOT NULL),
s AS (SELECT ticker, generator, path_id, 0 AS side, g AS x FROM made UNION ALL SELECT ticker, generator, path_id, 1, part.g FROM (SELECT DISTINCT ticker, generator, path_id FROM made) d JOIN part USING (ticker) WHERE early = (generator = 'normal')),
c AS (SELECT ticker, generator, path_id, x, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM s GROUP BY ALL),
up AS (SELECT *, sum(p) OVER o AS pu, sum(q) OVER o AS qu, sum(p) OVER w AS n, sum(q) OVER w AS m FROM c WINDOW w AS (PARTITION BY ticker, generator, path_id), o AS (PARTITION BY ticker, generator, path_id ORDER BY x)),
k AS (SELECT ticker, generator, path_id, any_value(n)::DOUBLE AS n, any_value(m)::DOUBLE AS m, max(abs(pu / n - qu / m)) AS ks FROM up GROUP BY ALL)
SELECT ticker, generator, count(*) AS paths, round(avg(ks), 6) AS mean_ks, round(avg(CASE WHEN {_KS_SQL} > 0.05 THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM k GROUP BY ALL"""


def _mixture_sql(family: str) -> str:
    low, high = _grid(family)
    if family == "normal":
        y = "(x / {s}::DOUBLE)"
        cdf = "0.5 + list_reduce(range(1, 201), lambda a, i: {{'t': a.t * {y} * {y} / (2 * i + 1), 's': a.s + a.t * {y} * {y} / (2 * i + 1)}}, {{'t': {y}, 's': {y}}}).s * exp(-{y} * {y} / 2) / sqrt(2 * pi())"
    else:
        y = "(x / {s}::DOUBLE)"
        z = f"({{y}} * {{y}} / ({NU} + {{y}} * {{y}}))"
        cdf = f"0.5 + exp(lgamma({(NU + 1) / 2}) - lgamma({NU / 2})) / sqrt(pi() * {NU}) * {{y}} / sqrt(1 + {{y}} * {{y}} / {NU}) * list_reduce(range(1, 1001), lambda a, n: {{{{'c': a.c * (n - {NU / 2}::DOUBLE) / n * {z}, 's': a.s + a.c * (n - {NU / 2}::DOUBLE) / n * {z} / (2 * n + 1)}}}}, {{{{'c': 1.0::DOUBLE, 's': 1.0::DOUBLE}}}}).s"
    columns = ", ".join(cdf.format(y=y.format(s=s)) + f" AS c{k + 1}" for k, s in enumerate(SIGMA))
    return f"""{_walked(3, False)}, grid AS (SELECT i, {low!r}::DOUBLE + i * {(high - low) / (mixture.GRID - 1)!r}::DOUBLE AS x FROM (SELECT unnest(range(0, {mixture.GRID})) AS i)), cdf AS (SELECT x, {columns} FROM grid),
hit AS (SELECT ticker, idx, coalesce(min(cdf.x) FILTER (q1 * c1 + q2 * c2 + q3 * c3 >= 0.05), {high!r}) AS var, any_value(told.x) AS y FROM told, cdf GROUP BY ticker, idx)
SELECT ticker, idx, round(var, 6) AS var, y < var AS breach FROM hit"""


ORACLES = {
    "hamilton_filter": _hamilton_sql(2),
    "hamilton_filter_three": _hamilton_sql(3),
    "predictive_states": f"{_walked(3, False)} SELECT ticker, idx, round(q1, 6) AS p_1, round(q2, 6) AS p_2, round(q3, 6) AS p_3 FROM f",
    "har_fit": f"""WITH {RETURNS_SQL}, {_SCALED}, {_har_sql("f0", "scaled")}, f AS (SELECT ticker, ln(rv) AS y, ln(rv_d) AS d, ln(rv_w) AS w, ln(rv_m) AS m FROM f0 WHERE rv > 0 AND rv_d > 0), {_solved_sql("fit", "f", ["1.0::DOUBLE", "d", "w", "m"], "y")}
SELECT ticker, n, round(b0, 6) AS b0, round(b1, 6) AS b_d, round(b2, 6) AS b_w, round(b3, 6) AS b_m FROM fit""",
    "dynamic_quantile": _dq_sql(),
    "sojourn_families": f"""WITH {_FITS} SELECT ticker, state, k AS n_runs, round(r, 5) AS nb_r, round(p, 5) AS nb_p, round(alpha, 5) AS pareto_alpha, d_min, d_max, round(ll_nb, 5) AS ll_nb, round(ll_pareto, 5) AS ll_pareto, CASE WHEN k >= 3 AND ll_pareto > ll_nb THEN 'pareto' ELSE 'nb' END AS family FROM pz JOIN ll USING (ticker, state)""",
    "pareto_table": f"""WITH {_FITS}, t AS (SELECT ticker, state, d, CAST(d AS DOUBLE) ** (-alpha - 1) / exp(ln_z) AS pmf FROM (SELECT *, unnest(range(d_min, d_max + 1)) AS d FROM pz))
SELECT ticker, state, d, round(pmf, 6) AS pmf, round(sum(pmf) OVER (PARTITION BY ticker, state ORDER BY d), 6) AS cdf, round(sum(d * pmf) OVER (PARTITION BY ticker, state), 6) AS mean FROM t""",
    "ged_deviations": f"""WITH {RETURNS_SQL}, s AS (SELECT ticker, shape, (shape * avg(abs(g / 100) ** shape)) ** (1 / shape) AS scale FROM returns, (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in SHAPES)}]) AS shape) GROUP BY ticker, shape)
SELECT ticker, shape, round(scale, 6) AS scale, round(scale * exp(0.5 * (lgamma(3 / shape) - lgamma(1 / shape))), 6) AS deviation FROM s""",
    "log_sum_exp": f"WITH {RETURNS_SQL}, m AS (SELECT ticker, max(g) AS m FROM returns GROUP BY ticker) SELECT ticker, count(*) AS n, round(any_value(m) + ln(sum(exp(g - m))), 6) AS lse FROM returns JOIN m USING (ticker) GROUP BY ticker",
    "rolling_log_sum_exp": f"WITH {RETURNS_SQL}, w AS (SELECT ticker, idx, list(g) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM returns) SELECT ticker, idx, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS lse FROM w WHERE idx >= 20",
    "mixture_var_normal": _mixture_sql("normal"),
    "mixture_var_t": _mixture_sql("t"),
    "decoded_state_var": f"""WITH {BINS_SQL}, r AS (SELECT ticker, idx, g, bin AS state, lag(g) OVER o AS b, lag(bin) OVER o AS was FROM binned WINDOW o AS (PARTITION BY ticker ORDER BY idx)),
p AS (SELECT ticker, state, avg(g) AS mu, stddev_samp(g) AS sd, coalesce(least(0.999, greatest(-0.999, regr_slope(g, b) FILTER (was = state))), 0) AS phi FROM r GROUP BY 1, 2),
s AS (SELECT ticker, state, any_value(mu) AS mu, any_value(phi) AS phi, coalesce(stddev_samp((g - mu) - phi * (b - mu)) FILTER (was = state), any_value(sd)) AS sigma FROM r JOIN p USING (ticker, state) GROUP BY 1, 2)
SELECT ticker, idx, round(g, 5) AS g, state, round(mu + phi * (coalesce(b, mu) - mu) + sigma * {NORMAL_05}, 5) AS var_step, round(mu + sigma / sqrt(greatest(1 - phi * phi, 1e-6)) * {NORMAL_05}, 5) AS var_still FROM r JOIN s USING (ticker, state)""",
    "bootstrap_kurtosis": _resampled_sql("k AS (SELECT ticker, mean_length, b, (kurtosis_pop(g) + 3) * ((count(*) - 1) / count(*)::DOUBLE) ** 2 - 3 AS k FROM boots GROUP BY ALL) SELECT ticker, CAST(mean_length AS INTEGER) AS mean_length, count(*) AS resamples, round(quantile_cont(k, 0.025), 4) AS q025, round(quantile_cont(k, 0.5), 4) AS q500, round(quantile_cont(k, 0.975), 4) AS q975 FROM k GROUP BY ALL"),
    "bootstrap_ks_critical": _resampled_sql("""c AS (SELECT ticker, mean_length, b, x, sum(p) AS p, sum(q) AS q FROM (SELECT ticker, mean_length, b, g AS x, 1 AS p, 0 AS q FROM boots UNION ALL SELECT ticker, mean_length, b, g, 0, 1 FROM (SELECT DISTINCT ticker, mean_length, b FROM boots) JOIN returns USING (ticker)) GROUP BY ALL),
e AS (SELECT ticker, mean_length, b, abs(sum(p) OVER o / sum(p) OVER w - sum(q) OVER o / sum(q) OVER w) AS gap FROM c WINDOW w AS (PARTITION BY ticker, mean_length, b), o AS (PARTITION BY ticker, mean_length, b ORDER BY x)),
k AS (SELECT ticker, mean_length, b, max(gap) AS k FROM e GROUP BY ALL) SELECT ticker, CAST(mean_length AS INTEGER) AS mean_length, count(*) AS resamples, round(quantile_cont(k, 0.5), 6) AS q500, round(quantile_cont(k, 0.95), 6) AS q950 FROM k GROUP BY ALL"""),
    "har_synthetic": _har_synthetic_sql(),
    "path_anderson_darling": f"{_ad_sql()} SELECT ticker, path_id, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(ks, 5) AS ks, round(a2, 5) AS a2, round(z, 5) AS z, round(p, 5) AS p FROM ad",
    "path_ad_pass": f"{_ad_sql()} SELECT ticker, count(*) AS paths, round(avg(z), 5) AS mean_z, round(avg(CASE WHEN p > 0.05 THEN 1.0 ELSE 0 END), 5) AS pass_rate FROM ad GROUP BY ticker",
    "path_panel": _panel_sql(),
    "archive_windows": f'WITH {_drawn_sql()} SELECT ticker, id AS "window", pos, round(g, 6) AS g FROM drawn',
    "median_bandwidth": f"WITH {_drawn_sql()}, {_VECTORS} SELECT ticker, round(bandwidth, 6) AS bandwidth FROM band",
    "window_mmd": f"WITH {_drawn_sql()}, {_VECTORS}, {_DISCREPANCY}",
    "signature_mmd": _signature_mmd_sql(),
    "ks_power": _ks_power_sql(),
    "window_signatures": f"WITH {RETURNS_SQL}, {_SEEN}, r AS (SELECT *, count(*) OVER w AS n, stddev_samp(g) OVER w AS sd FROM seen WINDOW w AS (PARTITION BY ticker, id)), " + _signature_sql("r", "ticker, id", 'ticker, id AS "window"'),
    "series_signature": f"WITH {RETURNS_SQL}, r AS (SELECT ticker, idx AS pos, g / 100 AS g, count(*) OVER w AS n, stddev_samp(g / 100) OVER w AS sd FROM returns WINDOW w AS (PARTITION BY ticker)), " + _signature_sql("r", "ticker", "ticker, any_value(n) AS n"),
}
QUERIES = {n: globals()[n] for n in ORACLES}
