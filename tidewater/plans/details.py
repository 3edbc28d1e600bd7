"""Queries of comparisons and small tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import comparisons, fidelity, likelihoods, scans, simulate, stats, timeseries, windowing
from tidewater.plans.panel import BARS_SQL, BINS_SQL, RETURNS_SQL, bars, returns, rounded
from tidewater.plans.reports import _KS_SQL, _MODES, MOVE, SIGMA, _matrix_sql, _modes, _paths, _scaled
from tidewater.plans.scores import _hashed, _walked
from tidewater.plans.validation import _PAIRS, _boot, _uniform


def _matrix(spark, sf_dir):
    return stats.transition_matrix(stats.ordinal_bins(returns(spark, sf_dir), 5), 5)


def common_dates(spark, sf_dir):
    """Days that all tickers have, by year, and how many days of any ticker are not among them."""
    held = bars(spark, sf_dir)
    all_ = held.select("dt").distinct()
    shared = comparisons.common_dates(held)
    missing = all_.join(shared, "dt", "left_anti")
    count = lambda df, c: df.groupBy(F.year("dt").alias("year")).agg(F.count("*").alias(c))
    return count(all_, "days").join(count(shared, "shared"), "year", "left").join(count(missing, "missing"), "year", "left").na.fill(0)


def picked_rows(spark, sf_dir):
    held = bars(spark, sf_dir)
    return rounded(comparisons.picked(held, comparisons.common_dates(held)).select("ticker", "place", "dt", "vwap"))


def positional_correlation(spark, sf_dir):
    """Correlations of tickers lined up by place, not by date."""
    got = comparisons.positional_pairs(returns(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))
    return rounded(got)


def stitch_verdicts(spark, sf_dir):
    """Every pair of tickers as two sources: rank test of their returns and the largest gap of rolling kurtosis on common dates."""
    r = returns(spark, sf_dir)
    ks = fidelity.ks_distance(fidelity.ticker_pairs(r), "a", "b").withColumn("ks_p", fidelity.ks_p_value(F.col("ks"), F.col("n"), F.col("m")))
    k = timeseries.rolling_kurtosis(r, 60).where("kurt is not null").select("ticker", "dt", "kurt")
    left = k.select(F.col("ticker").alias("a"), "dt", F.col("kurt").alias("x"))
    gaps = left.join(k.select(F.col("ticker").alias("b"), "dt", F.col("kurt").alias("y")), "dt").where("a < b").groupBy("a", "b").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("kurtosis_gap"))
    got = ks.join(gaps, ["a", "b"], "left")
    return rounded(got.select("a", "b", "ks_p", "kurtosis_gap", *comparisons.stitch_verdict(F.col("ks_p"), F.col("kurtosis_gap"))))


def var_envelope(spark, sf_dir):
    """Median and 90 % range over paths of each path's 5 % quantile, with the report's cell read back."""
    each = _paths(spark, sf_dir).groupBy("ticker", "path_id").agg(F.percentile("g", F.lit(0.05)).alias("var"))
    got = comparisons.envelope(each, "ticker", x="var")
    back = [c.alias(f"read_{n}") for c, n in zip(comparisons.cell_numbers(F.col("cell")), ("median", "low", "high"), strict=True)]
    return rounded(got.select("ticker", "median", "low", "high", *back), 3)


def simulated_p_values(spark, sf_dir):
    """Where the observed excess kurtosis and lag-1 leverage stand among the paths'."""
    paths = _paths(spark, sf_dir)
    seen = returns(spark, sf_dir).groupBy("ticker").agg(stats.sample_excess_kurtosis().alias("k"))
    made = paths.groupBy("ticker", "path_id").agg(stats.sample_excess_kurtosis().alias("k"))
    return rounded(comparisons.simulated_p(seen, made, ["ticker"], "k"), 5)


def jump_matrix(spark, sf_dir):
    return rounded(comparisons.jump_matrix(_matrix(spark, sf_dir)))


def emission_matrix(spark, sf_dir):
    return rounded(comparisons.emission_matrix(_matrix(spark, sf_dir).select(F.col("from_state").alias("state")).distinct()))


def _by_quarter(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("bin", F.quarter("dt"))


def canonical_matrix(spark, sf_dir):
    """Quarters of the year as states, numbered by their deviation."""
    rows = _by_quarter(spark, sf_dir)
    scales = rows.groupBy("ticker", F.col("bin").alias("state")).agg(F.stddev_samp("g").alias("scale"))
    return rounded(comparisons.canonical_matrix(stats.transition_matrix(rows, 4), scales))


def matrix_distances(spark, sf_dir):
    return rounded(comparisons.matrix_distances(_matrix(spark, sf_dir)))


def softmax_shares(spark, sf_dir):
    """Shares of tickers in a year by their deviations."""
    rows = _modes(spark, sf_dir).groupBy("ticker", F.year("dt").alias("year")).agg((F.stddev_samp("g") / 50).alias("x")).where("x is not null")
    return rounded(comparisons.softmax(rows, ["year"], "x"))


def ged_shapes(spark, sf_dir):
    rows = _modes(spark, sf_dir).withColumn("year", F.year("dt"))
    return rounded(comparisons.ged_shapes(rows, "ticker", "year"))


def ged_shape_classes(spark, sf_dir):
    rows = _modes(spark, sf_dir).withColumn("year", F.year("dt"))
    return comparisons.shape_classes(comparisons.ged_shapes(rows, "ticker", "year"), "ticker")


def pair_errors(spark, sf_dir):
    paths = simulate.bootstrap_paths(_modes(spark, sf_dir), 20, 50)
    return rounded(comparisons.pair_errors(stats.correlation_pairs(_modes(spark, sf_dir)), paths))


def universe_without(spark, sf_dir):
    """Errors of correlations of the universe with and without one ticker."""
    paths = simulate.bootstrap_paths(_modes(spark, sf_dir), 20, 50)
    return rounded(comparisons.with_and_without(comparisons.pair_errors(stats.correlation_pairs(_modes(spark, sf_dir)), paths), "s3"))


def tail_quantiles(spark, sf_dir):
    return rounded(comparisons.tail_quantiles(returns(spark, sf_dir), _paths(spark, sf_dir)), 5)


def gaussian_paths_hash(spark, sf_dir):
    return rounded(simulate.gaussian_paths(returns(spark, sf_dir), 20, 50), 5)


def index_residuals(spark, sf_dir):
    return rounded(simulate.index_residuals(returns(spark, sf_dir), "R"), 5)


def index_paths_hash(spark, sf_dir):
    r = returns(spark, sf_dir)
    market = simulate.bootstrap_paths(r.where("ticker = 'R'"), 20, 50).select("path_id", "t", F.col("g").alias("m"))
    return rounded(simulate.index_paths(simulate.index_residuals(r, "R"), market, 3), 5)


def held_out_forward_stationary(spark, sf_dir):
    """Log-likelihood of the series under three states from their stationary probabilities."""
    rows = likelihoods.filtered_states(_scaled(spark, sf_dir), MOVE, SIGMA, scans.stationary(MOVE))
    return rounded(rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("ll").alias("ll")), 5)


def windows_stride_one(spark, sf_dir):
    """Mean and last value of every window of 20 steps."""
    rows = windowing.windowize(returns(spark, sf_dir), 20, 1)
    return rounded(rows.groupBy("ticker", "window").agg(F.avg("g").alias("mean"), F.max_by("g", "pos").alias("last")))


_MATRIX = f"{BINS_SQL}, s AS (SELECT unnest(range(1, 6)) AS k), {_matrix_sql('ma', 'true')}"
_LGAMMA_RATIO = "exp(lgamma(2 / p) - 0.5 * (lgamma(1 / p) + lgamma(3 / p)))"
_SHAPES = f"""{_MODES}, ym AS (SELECT ticker, year(dt) AS year, g, avg(g) OVER (PARTITION BY ticker, year(dt)) AS m FROM modes), yr AS (SELECT ticker, year, avg(abs(g - m)) / nullif(sqrt(avg((g - m) ** 2)), 0) AS ratio FROM ym GROUP BY 1, 2),
gr AS (SELECT p, {_LGAMMA_RATIO} AS r FROM (SELECT 0.5::DOUBLE + i * 0.01::DOUBLE AS p FROM (SELECT unnest(range(0, 251)) AS i))), sh AS (SELECT ticker, year, ratio, arg_min(p, abs(r - ratio)) AS shape FROM yr, gr GROUP BY ALL)"""
_MODE_PATHS = f"""{_MODES}, {_uniform(20, 50)}, n AS (SELECT ticker, count(*) AS n FROM modes GROUP BY ticker), boot AS (SELECT r.ticker, path_id, t, g FROM u JOIN n ON true JOIN modes r ON r.ticker = n.ticker AND r.idx = CAST(floor(u * n) AS BIGINT) + 1),
o AS (SELECT x.ticker AS a, y.ticker AS b, corr(x.g, y.g) AS rho FROM modes x JOIN modes y ON x.dt = y.dt AND x.ticker < y.ticker GROUP BY 1, 2),
sp AS (SELECT path_id, x.ticker AS a, y.ticker AS b, corr(x.g, y.g) AS rho FROM boot x JOIN boot y USING (path_id, t) WHERE x.ticker < y.ticker GROUP BY 1, 2, 3),
er AS (SELECT a, b, any_value(o.rho) AS rho, avg(sp.rho) AS made, abs(avg(sp.rho) - any_value(o.rho)) AS error FROM sp JOIN o USING (a, b) GROUP BY a, b)"""
_RESIDUALS = f"""{RETURNS_SQL}, lr AS (SELECT a.ticker, a.dt, a.g AS y, m.g AS x FROM returns a JOIN returns m ON a.dt = m.dt AND m.ticker = 'R' WHERE a.ticker <> 'R'), lf AS (SELECT ticker, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha, count(*) AS k FROM lr GROUP BY ticker),
re AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS place, alpha, beta, y - alpha - beta * x AS residual FROM lr JOIN lf USING (ticker))"""
_QUANTILES = ", ".join(repr(0.001 + i * (1 - 2 * 0.001) / 199) for i in range(200))


def _stationary_sql() -> str:
    start = scans.stationary(MOVE)
    sql = _walked(3, False)
    for j in range(3):
        sql = sql.replace(f"CAST({1 / 3!r} AS DOUBLE) AS q{j + 1}", f"CAST({start[j]!r} AS DOUBLE) AS q{j + 1}")
    return f"{sql} SELECT ticker, count(*) AS n, round(sum(ln(u1 + u2 + u3)), 5) AS ll FROM told GROUP BY ticker"


ORACLES = {
    "common_dates": f"""WITH {BARS_SQL}, d AS (SELECT dt, count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars) AS shared FROM bars GROUP BY dt)
SELECT CAST(year(dt) AS INTEGER) AS year, count(*) AS days, count(*) FILTER (shared) AS shared, count(*) FILTER (NOT shared) AS missing FROM d GROUP BY 1""",
    "picked_rows": f"""WITH {BARS_SQL}, d AS (SELECT dt FROM bars GROUP BY dt HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars))
SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY dt) AS INTEGER) AS place, dt, round(vwap, 6) AS vwap FROM bars JOIN d USING (dt)""",
    "positional_correlation": f"WITH {RETURNS_SQL} SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, round(corr(x.g, y.g), 6) AS rho FROM returns x JOIN returns y ON x.idx = y.idx AND x.ticker < y.ticker GROUP BY 1, 2",
    "stitch_verdicts": f"""WITH {_PAIRS}, c AS (SELECT a, b, x, sum(1 - side) AS p, sum(side) AS q FROM s GROUP BY 1, 2, 3), e AS (SELECT a, b, abs(sum(p) OVER o / sum(p) OVER w - sum(q) OVER o / sum(q) OVER w) AS gap, sum(p) OVER w AS n, sum(q) OVER w AS m FROM c WINDOW w AS (PARTITION BY a, b), o AS (PARTITION BY a, b ORDER BY x)),
k AS (SELECT a, b, max(gap) AS ks, CAST(any_value(n) AS DOUBLE) AS n, CAST(any_value(m) AS DOUBLE) AS m FROM e GROUP BY 1, 2), kp AS (SELECT a, b, {_KS_SQL} AS ks_p FROM k),
rk AS (SELECT ticker, dt, idx, kurtosis_pop(g) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS kurt FROM returns),
kg AS (SELECT x.ticker AS a, y.ticker AS b, max(abs(x.kurt - y.kurt)) AS gap FROM rk x JOIN rk y ON x.dt = y.dt AND x.ticker < y.ticker WHERE x.idx >= 60 AND y.idx >= 60 GROUP BY 1, 2)
SELECT a, b, round(ks_p, 6) AS ks_p, round(gap, 6) AS kurtosis_gap, CASE WHEN ks_p < 0.01 THEN 'FAIL' ELSE 'PASS' END AS verdict, concat_ws(',', CASE WHEN ks_p < 0.01 THEN 'distribution' END, CASE WHEN gap > 1.5 THEN 'kurtosis' END) AS notes FROM kp LEFT JOIN kg USING (a, b)""",
    "var_envelope": f"""WITH {_boot(20, 50)}, v AS (SELECT ticker, path_id, quantile_cont(g, 0.05) AS v FROM boot GROUP BY 1, 2), e AS (SELECT ticker, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.05) AS l, quantile_cont(v, 0.95) AS h FROM v GROUP BY ticker),
c AS (SELECT *, printf('%.3f [%.3f, %.3f]', m, l, h) AS cell FROM e) SELECT ticker, round(m, 3) AS median, round(l, 3) AS low, round(h, 3) AS high, round(CAST(regexp_extract(cell, '^([^ ]+)', 1) AS DOUBLE), 3) AS read_median, round(CAST(regexp_extract(cell, '\\[([^,]+),', 1) AS DOUBLE), 3) AS read_low, round(CAST(regexp_extract(cell, ', ([^\\]]+)\\]', 1) AS DOUBLE), 3) AS read_high FROM c""",
    "simulated_p_values": f"""WITH {_boot(20, 50)}, m AS (SELECT ticker, path_id, (kurtosis_pop(g) + 3) * ((count(*) - 1) / count(*)::DOUBLE) ** 2 - 3 AS k FROM boot GROUP BY 1, 2), o AS (SELECT ticker, (kurtosis_pop(g) + 3) * ((count(*) - 1) / count(*)::DOUBLE) ** 2 - 3 AS k FROM returns GROUP BY 1),
c AS (SELECT ticker, median(k) AS c FROM m GROUP BY ticker) SELECT ticker, round(any_value(o.k), 5) AS observed, round(any_value(c), 5) AS median, round(avg(CASE WHEN abs(m.k - c) >= abs(o.k - c) THEN 1.0 ELSE 0 END), 5) AS p FROM m JOIN o USING (ticker) JOIN c USING (ticker) GROUP BY ticker""",
    "jump_matrix": f"WITH {_MATRIX} SELECT ticker, CAST(f AS INTEGER) AS from_state, CAST(t AS INTEGER) AS to_state, round((1 - p) / sum(1 - p) OVER (PARTITION BY ticker, f), 6) AS p FROM ma",
    "emission_matrix": f"WITH {_MATRIX}, d AS (SELECT DISTINCT f AS state FROM ma) SELECT CAST(a.state AS INTEGER) AS state, CAST(b.state AS INTEGER) AS symbol, round(CASE WHEN a.state = b.state THEN 1.0 ELSE 0.001 END / sum(CASE WHEN a.state = b.state THEN 1.0 ELSE 0.001 END) OVER (PARTITION BY a.state), 6) AS p FROM d a, d b",
    "canonical_matrix": f"""WITH {RETURNS_SQL}, binned AS (SELECT ticker, dt, idx, g, quarter(dt) AS bin FROM returns), q AS (SELECT ticker, bin AS f, lead(bin) OVER (PARTITION BY ticker ORDER BY idx) AS t FROM binned),
rk AS (SELECT ticker, bin, row_number() OVER (PARTITION BY ticker ORDER BY stddev_samp(g), bin) AS r FROM binned GROUP BY ticker, bin), c AS (SELECT ticker, f, t, count(*) AS n FROM q WHERE t IS NOT NULL GROUP BY 1, 2, 3)
SELECT x.ticker, CAST(x.r AS INTEGER) AS from_state, CAST(y.r AS INTEGER) AS to_state, round(CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY x.ticker, x.bin) > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY x.ticker, x.bin) ELSE 0.25 END, 6) AS p FROM rk x JOIN rk y ON x.ticker = y.ticker LEFT JOIN c ON c.ticker = x.ticker AND c.f = x.bin AND c.t = y.bin""",
    "matrix_distances": f"WITH {_MATRIX} SELECT x.ticker AS a, y.ticker AS b, round(sqrt(sum((x.p - y.p) ** 2)), 6) AS frobenius FROM ma x JOIN ma y ON x.f = y.f AND x.t = y.t AND x.ticker < y.ticker GROUP BY 1, 2",
    "softmax_shares": f"WITH {_MODES}, y AS (SELECT ticker, CAST(year(dt) AS INTEGER) AS year, stddev_samp(g) / 50 AS x FROM modes GROUP BY 1, 2 HAVING count(*) > 1) SELECT ticker, year, round(x, 6) AS x, round(exp(x) / sum(exp(x)) OVER (PARTITION BY year), 6) AS share FROM y",
    "ged_shapes": f"WITH {_SHAPES} SELECT ticker, CAST(year AS INTEGER) AS year, round(ratio, 6) AS ratio, round(shape, 6) AS shape FROM sh",
    "ged_shape_classes": f"WITH {_SHAPES} SELECT ticker, count(*) FILTER (shape >= 1.85) AS gauss, count(*) FILTER (shape >= 1.3 AND shape < 1.85) AS between, count(*) FILTER (shape >= 0.85 AND shape < 1.3) AS laplace, count(*) FILTER (shape < 0.85) AS sharper FROM sh GROUP BY ticker",
    "pair_errors": f"WITH {_MODE_PATHS} SELECT a, b, round(rho, 6) AS rho, round(made, 6) AS made, round(error, 6) AS error FROM er",
    "universe_without": f"WITH {_MODE_PATHS} SELECT round(avg(error), 6) AS all_pairs, round(avg(error) FILTER (a <> 's3' AND b <> 's3'), 6) AS without, round(avg(error) FILTER (a = 's3' OR b = 's3'), 6) AS own_pairs FROM er",
    "tail_quantiles": f"""WITH {_boot(20, 50)}, a AS (SELECT ticker, quantile_cont(g, [{_QUANTILES}]) AS p FROM returns GROUP BY ticker), b AS (SELECT ticker, quantile_cont(g, [{_QUANTILES}]) AS q FROM boot GROUP BY ticker)
SELECT ticker, CAST(unnest(range(0, 200)) AS INTEGER) AS i, round(unnest(p), 5) AS observed, round(unnest(q), 5) AS simulated FROM a JOIN b USING (ticker)""",
    "gaussian_paths_hash": f"""WITH {RETURNS_SQL}, f AS (SELECT ticker, avg(g) AS m, stddev_samp(g) AS s FROM returns GROUP BY ticker), pt AS (SELECT * FROM (SELECT unnest(range(1, 21)) AS path_id), (SELECT unnest(range(1, 51)) AS t))
SELECT ticker, path_id, t, round(m + s * sqrt(-2 * ln({_hashed("path_id", "t", 2)})) * cos(2 * pi() * {_hashed("path_id", "t", 3)}), 5) AS g FROM pt, f""",
    "index_residuals": f"WITH {_RESIDUALS} SELECT ticker, place, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(residual, 5) AS residual FROM re",
    "index_paths_hash": f"""WITH {_RESIDUALS}, {_uniform(20, 50)}, mk AS (SELECT path_id, t, g AS m FROM u JOIN returns r ON r.ticker = 'R' AND r.idx = CAST(floor(u * (SELECT count(*) FROM returns WHERE ticker = 'R')) AS BIGINT) + 1)
SELECT re.ticker, path_id, t, round(re.alpha + re.beta * m + residual, 5) AS g FROM mk, lf JOIN re ON re.ticker = lf.ticker AND re.place = CAST(floor({_hashed("path_id", "t", 3)} * k) AS BIGINT) + 1""",
    "held_out_forward_stationary": _stationary_sql(),
    "windows_stride_one": f"""WITH {RETURNS_SQL}, w AS (SELECT ticker, idx - 19 AS "window", avg(g) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean, g AS last FROM returns) SELECT ticker, "window", round(mean, 6) AS mean, round(last, 6) AS last FROM w WHERE "window" >= 1""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
