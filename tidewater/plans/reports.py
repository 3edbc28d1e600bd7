"""Queries on selections, windows, rollups, path scores and filters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import fidelity, likelihoods, recursions, risk, simulate, stats, summaries, timeseries, windowing
from tidewater.operators.returns import log_growth, split_at_anniversary
from tidewater.plans.panel import BARS_SQL, BINS_SQL, RETURNS_SQL, bars, returns, rounded
from tidewater.plans.validation import _PDF, _Z, _boot, _tail, _uniform, _walk
from tidewater.sources.bars import lineitem_bars

#: Seven tickers of lineitem, and a dimension of theirs, one of them without rows: fixed for these queries.
SHELF = "concat('s', l_suppkey % 7)"
GROUPS = [("s0", "air"), ("s1", "air"), ("s2", "land"), ("s3", "land"), ("s4", "land"), ("s5", "sea"), ("s9", "sea")]
#: Level of the log variance, and minus the mean of ln chi-squared with one degree of freedom: Euler's constant and ln 2.
LEVEL, LOG_CHI2 = 0.4, 1.2703628454614781
MOVE, SIGMA = [[0.95, 0.04, 0.01], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]], [0.6, 1.0, 1.9]


def _scaled(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("g", F.col("g") / 100)


def _paths(spark, sf_dir):
    return simulate.bootstrap_paths(returns(spark, sf_dir), 20, 50)


def _train(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("train", F.col("dt") < F.lit("1996-01-01").cast("date"))


def _modes(spark, sf_dir):
    return log_growth(lineitem_bars(spark, sf_dir, SHELF))


def _groups(spark):
    return spark.createDataFrame(GROUPS, "ticker string, grp string")


def growth_complete_rows(spark, sf_dir):
    holed = bars(spark, sf_dir).withColumn("volume", F.when(F.col("n") % 7 > 0, F.col("volume")))
    return rounded(log_growth(holed.dropna()))


def growth_of_vectors(spark, sf_dir):
    held = bars(spark, sf_dir).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("dt", "vwap"))), lambda s: s["vwap"]).alias("prices"))
    return rounded(windowing.vector_growth(held))


def in_both_parts(spark, sf_dir):
    rows = split_at_anniversary(bars(spark, sf_dir), "A", years=2)
    return windowing.in_every_part(rows).groupBy("ticker", "part").agg(F.count("*").alias("n"))


def closed_slice(spark, sf_dir):
    return rounded(returns(spark, sf_dir).where("dt between date'1996-02-01' and date'1997-03-15'"))


def zscore_train(spark, sf_dir):
    return rounded(windowing.standardised(_train(spark, sf_dir), "train").select("ticker", "idx", "z"))


def windows_as_rows(spark, sf_dir):
    return rounded(windowing.windowize(returns(spark, sf_dir), 20, 15))


def windows_and_next(spark, sf_dir):
    rows = windowing.window_targets(returns(spark, sf_dir), 10)
    return rounded(rows.select("ticker", "idx", F.expr("aggregate(past, 0D, (s, x) -> s + x) / 10").alias("mean"), F.expr("past[9]").alias("last"), "y"))


def differenced(spark, sf_dir):
    return rounded(windowing.differences(returns(spark, sf_dir)))


def vendor_fallback(spark, sf_dir):
    first, second = lineitem_bars(spark, sf_dir, SHELF).where("ticker <> 's5'"), lineitem_bars(spark, sf_dir, SHELF)
    wanted = _groups(spark).select("ticker")
    return windowing.with_fallback(wanted, first, second).groupBy("ticker", "source").agg(F.count("*").alias("n"))


def lookup_skips(spark, sf_dir):
    held = lineitem_bars(spark, sf_dir, SHELF).select("ticker").distinct()
    return _groups(spark).join(held, "ticker", "left_anti")


def archive_merge(spark, sf_dir):
    fits = lambda df, name: df.groupBy("ticker").agg(F.avg("g").alias("mean")).withColumn("archive", F.lit(name))
    r = _modes(spark, sf_dir)
    return rounded(windowing.by_priority(["ticker"], fits(r, "old"), fits(r.where("idx <= 100 and ticker in ('s0', 's4')"), "new")))


def rank_reorder(spark, sf_dir):
    r = returns(spark, sf_dir)
    u = r.withColumn("u", F.sin(F.col("idx") * 12.9898)).select("ticker", "idx", "u")
    return rounded(windowing.rank_reordered(r.select("ticker", "idx", "g"), u))


def group_rollup(spark, sf_dir):
    scores = _modes(spark, sf_dir).groupBy("ticker").agg(F.stddev_samp("g").alias("score"))
    return rounded(summaries.group_rollup(scores, _groups(spark), 100.0), 5)


def five_stats(spark, sf_dir):
    return rounded(summaries.five_stats(returns(spark, sf_dir), "ticker", "g"), 5)


def across_years(spark, sf_dir):
    years = returns(spark, sf_dir).groupBy("ticker", F.year("dt").alias("year")).agg(F.stddev_samp("g").alias("sd")).where("sd is not null")
    return rounded(summaries.across(years.withColumnRenamed("sd", "score"), "ticker", "score"), 5)


def path_bands(spark, sf_dir):
    ends = _paths(spark, sf_dir).groupBy("ticker", "path_id").agg(F.sum("g").alias("total"))
    return rounded(summaries.band(ends, "ticker", x="total"), 5)


def transition_distance(spark, sf_dir):
    binned = stats.ordinal_bins(_train(spark, sf_dir), 5)
    a, b = (stats.transition_matrix(binned.where(w), 5) for w in ("train", "not train"))
    return rounded(summaries.matrix_distance(a, b, ["ticker"], ["from_state", "to_state"]))


def information_criteria(spark, sf_dir):
    r = _scaled(spark, sf_dir)
    ll = recursions.two_state_filter(recursions.series(r), (0.95, 0.9), (0.9, 1.6)).join(r.groupBy("ticker").agg(F.count("*").cast("double").alias("n")), "ticker")
    return rounded(summaries.information_criteria(ll, 2), 5)


def acf_bands(spark, sf_dir):
    r = returns(spark, sf_dir)
    n = r.groupBy("ticker").agg((2.576 / F.sqrt(F.count("*"))).alias("band"))
    return rounded(stats.autocorrelations(r, 20).join(n, "ticker").withColumn("outside", F.abs("rho") > F.col("band")))


def lag1_pearson(spark, sf_dir):
    return rounded(timeseries.lag1_pearson(returns(spark, sf_dir)))


def leverage_asymmetry(spark, sf_dir):
    return rounded(summaries.leverage_asymmetry(returns(spark, sf_dir)), 5)


def residence_times(spark, sf_dir):
    stay = stats.transition_matrix(stats.ordinal_bins(returns(spark, sf_dir), 5), 5).where("from_state = to_state")
    return rounded(stay.select("ticker", F.col("from_state").alias("state"), (1 / F.nullif(1 - F.col("p"), F.lit(0.0))).alias("steps")))


def loss_difference(spark, sf_dir):
    r = returns(spark, sf_dir)
    past = F.lag("g").over(timeseries._by())
    d = r.withColumn("g", F.col("g") ** 2 / 1e4 - (F.col("g") - past) ** 2 / 1e4).where("g is not null").withColumn("idx", F.col("idx") - 1)
    own = d.groupBy("ticker").agg((F.stddev_samp("g") / F.sqrt(F.count("g"))).alias("se_indep"))
    got = timeseries.newey_west(d).join(own, "ticker").withColumn("z_indep", F.col("mean") / F.nullif("se_indep", F.lit(0.0)))
    return rounded(got.select("ticker", "n", "h", "mean", "lrv", "se_indep", "z_indep", "z"), 5)


def vol_target(spark, sf_dir):
    w = timeseries._by().rowsBetween(-20, -1)
    rows = _scaled(spark, sf_dir).withColumn("variance", F.var_samp("g").over(w)).where("idx > 20")
    return rounded(summaries.vol_target(rows), 6)


def laplace_qq(spark, sf_dir):
    r = returns(spark, sf_dir)
    return rounded(summaries.laplace_qq(r, stats.laplace_fit(r)), 5)


def path_ks_pass(spark, sf_dir):
    paths = _paths(spark, sf_dir).select("ticker", "path_id", F.lit(0).alias("side"), F.col("g").alias("x"))
    seen = paths.select("ticker", "path_id").distinct().join(returns(spark, sf_dir).select("ticker", F.lit(1).alias("side"), F.col("g").alias("x")), "ticker")
    ks = fidelity.ks_distance(paths.unionByName(seen), "ticker", "path_id").withColumn("p", fidelity.ks_p_value(F.col("ks"), F.col("n"), F.col("m")))
    return rounded(ks.groupBy("ticker").agg(F.count("*").alias("paths"), F.avg("ks").alias("mean_ks"), F.avg((F.col("p") > 0.05).cast("double")).alias("pass_rate")))


def path_kurtosis(spark, sf_dir):
    each = _paths(spark, sf_dir).groupBy("ticker", "path_id").agg(stats.sample_excess_kurtosis().alias("k"))
    return rounded(each.groupBy("ticker").agg(F.avg("k").alias("mean_kurtosis")), 5)


def _path_acf(spark, sf_dir, size: bool = False):
    paths = _paths(spark, sf_dir)
    return stats.path_autocorrelations(paths.withColumn("g", F.abs("g")) if size else paths, 5)


def path_acf_error(spark, sf_dir):
    return rounded(summaries.acf_error(_path_acf(spark, sf_dir), stats.autocorrelations(returns(spark, sf_dir), 5)))


def path_acf_error_abs(spark, sf_dir):
    """Errors of the autocorrelations of sizes: volatility clustering."""
    seen = returns(spark, sf_dir).withColumn("g", F.abs("g"))
    return rounded(summaries.acf_error(_path_acf(spark, sf_dir, True), stats.autocorrelations(seen, 5)))


def path_acf_envelope(spark, sf_dir):
    return rounded(summaries.band(_path_acf(spark, sf_dir), "ticker", "lag", x="rho", probs=(0.1, 0.9)))


def path_acf_envelope_abs(spark, sf_dir):
    return rounded(summaries.band(_path_acf(spark, sf_dir, True), "ticker", "lag", x="rho", probs=(0.1, 0.9)))


def ljung_box_abs(spark, sf_dir):
    return rounded(stats.ljung_box(returns(spark, sf_dir).withColumn("g", F.abs("g"))), 5)


def pooled_breaches(spark, sf_dir):
    """Breaches of the pooled paths' quantiles at 1 and 5 %, at most which counts, with the coverage statistics."""
    pool = _paths(spark, sf_dir).groupBy("ticker").agg(F.percentile("g", F.array(F.lit(0.01), F.lit(0.05))).alias("q"))
    hits = returns(spark, sf_dir).join(pool, "ticker").select("ticker", "idx", "g", F.explode(F.arrays_zip(F.array(F.lit(0.01), F.lit(0.05)).alias("alpha"), "q")).alias("z"))
    hits = hits.select("ticker", "idx", F.col("z.alpha").alias("alpha"), F.col("z.q").alias("var"), (F.col("g") <= F.col("z.q")).alias("breach"))
    found = [risk.coverage_tests(hits.where(F.col("alpha") == a), a, "ticker").withColumn("alpha", F.lit(a)) for a in (0.01, 0.05)]
    got = found[0].unionByName(found[1]).join(hits.groupBy("ticker", "alpha").agg(F.first("var").alias("var")), ["ticker", "alpha"])
    return rounded(got.select("ticker", "alpha", "var", "n", "x", (F.col("x") / F.col("n")).alias("rate"), "lr_uc", "p_uc", "lr_ind", "p_ind"), 5)


def exact_binomial(spark, sf_dir):
    counts = risk.breach_counts(risk.rolling_breaches(returns(spark, sf_dir), 0.05, 250), "ticker").select("ticker", "n", "x")
    return rounded(summaries.binomial_two_sided(counts, 0.05), 8)


def filtered_historical_var(spark, sf_dir):
    r = _scaled(spark, sf_dir)
    path = likelihoods.garch_variance_path(r, 0.05, 0.08, 0.85).withColumn("z", F.col("x") / F.sqrt("s2"))
    q = path.where("idx <= 100").groupBy("ticker").agg(F.expr("percentile_disc(0.05) within group (order by z)").alias("q"))
    out = path.where("idx > 100").join(q, "ticker").withColumn("var", F.col("q") * F.sqrt("s2"))
    return rounded(out.select("ticker", "idx", "var", (F.col("x") < F.col("var")).alias("breach")))


def garch_variance(spark, sf_dir):
    return rounded(likelihoods.garch_variance_path(_scaled(spark, sf_dir), 0.05, 0.08, 0.85))


def stochastic_volatility(spark, sf_dir):
    """Kalman quasi-likelihood of centred log squares, floored, with the mean of ln chi-squared(1) taken out, around a given level."""
    r = _scaled(spark, sf_dir)
    mean = r.groupBy("ticker").agg(F.avg("g").alias("mean"))
    r = r.join(mean, "ticker").withColumn("g", F.log(F.greatest((F.col("g") - F.col("mean")) ** 2, F.lit(1e-12))) + LOG_CHI2)
    return rounded(likelihoods.stochastic_volatility(recursions.series(r), 0.95, 0.09, f"{LEVEL}D"), 5)


def jump_diffusion(spark, sf_dir):
    return rounded(likelihoods.jump_diffusion(_scaled(spark, sf_dir), 0.01, 0.9, 0.1, -0.05, 1.8), 5)


def _filtered(spark, sf_dir):
    return likelihoods.filtered_states(_scaled(spark, sf_dir), MOVE, SIGMA)


def held_out_forward(spark, sf_dir):
    return rounded(_filtered(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("ll").alias("ll")), 5)


def volatility_band(spark, sf_dir):
    return rounded(likelihoods.state_band(_filtered(spark, sf_dir), 2, 3))


def correlation_reproduction(spark, sf_dir):
    """Frobenius mean and deviation over paths, and the mean error off the diagonal, of the paths' correlations against the series'."""
    paths = simulate.bootstrap_paths(_modes(spark, sf_dir), 20, 50)
    return rounded(summaries.correlation_gaps(stats.correlation_pairs(_modes(spark, sf_dir)), paths))


def dominant_share(spark, sf_dir):
    rows = _modes(spark, sf_dir).groupBy("ticker", F.year("dt").alias("year")).agg(F.sum("g").alias("g"))
    return rounded(summaries.dominant_share(rows.withColumnRenamed("ticker", "member"), "year", "g"))


_SCORED = """SELECT 's' || (l_suppkey % 7) AS ticker, CAST(l_shipdate AS DATE) AS dt, sum(l_extendedprice) / sum(l_quantity) AS vwap, count(*) AS n FROM lineitem GROUP BY 1, 2"""
_MODES = f"""mode_bars AS ({_SCORED}), mode_lag AS (SELECT *, lag(vwap) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM mode_bars),
modes AS (SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS idx, 252 * ln(vwap / prev) AS g FROM mode_lag WHERE prev IS NOT NULL)"""
_GROUP_ROWS = "groups(ticker, grp) AS (VALUES " + ", ".join(str(g) for g in GROUPS) + ")"
_TRAIN = f"{RETURNS_SQL}, train AS (SELECT *, dt < DATE '1996-01-01' AS train FROM returns)"


def _matrix_sql(name: str, where: str) -> str:
    return f"""{name}_p AS (SELECT ticker, bin, lead(bin) OVER (PARTITION BY ticker ORDER BY idx) AS t FROM binned WHERE {where}),
{name} AS (SELECT c.ticker, f, t, CASE WHEN sum(n) OVER (PARTITION BY c.ticker, f) > 0 THEN n / sum(n) OVER (PARTITION BY c.ticker, f) ELSE 0.2 END AS p FROM (
 SELECT g.ticker, g.f, g.t, count(q.bin) AS n FROM (SELECT DISTINCT ticker, a.k AS f, b.k AS t FROM (SELECT ticker FROM binned WHERE {where}), s a, s b) g LEFT JOIN {name}_p q ON q.ticker = g.ticker AND q.bin = g.f AND q.t = g.t GROUP BY 1, 2, 3) c)"""


def _path_acf_sql(g: str = "g") -> str:
    acf = lambda source, key: f"SELECT {key}, lag, sum((x.g - m) * (y.g - m)) / any_value(ss) AS rho FROM {source} x JOIN (SELECT unnest(range(1, 6)) AS lag) l ON true JOIN {source} y USING ({key}) JOIN (SELECT {key}, avg(g) AS m, var_pop(g) * count(*) AS ss FROM {source} GROUP BY {key}) USING ({key}) WHERE y.i = x.i + lag GROUP BY {key}, lag"
    return f"""{_boot(20, 50)}, b AS (SELECT ticker, path_id, t AS i, {g} AS g FROM boot), o AS (SELECT ticker, idx AS i, {g} AS g FROM returns),
pa AS ({acf('b', 'ticker, path_id')}), oa AS ({acf('o', 'ticker')})"""


def _acf_error_sql(g: str) -> str:
    return f"""WITH {_path_acf_sql(g)}, j AS (SELECT p.ticker, path_id, p.lag, p.rho, o.rho AS y FROM pa p JOIN oa o ON o.ticker = p.ticker AND o.lag = p.lag), e AS (SELECT ticker, path_id, avg(abs(rho - y)) AS e FROM j GROUP BY 1, 2),
m AS (SELECT ticker, lag, avg(rho) - any_value(y) AS d FROM j GROUP BY 1, 2)
SELECT ticker, round(a, 6) AS mean_of_mae, round(b, 6) AS mae_of_mean FROM (SELECT ticker, avg(e) AS a FROM e GROUP BY ticker) JOIN (SELECT ticker, avg(abs(d)) AS b FROM m GROUP BY ticker) USING (ticker)"""


def _acf_envelope_sql(g: str) -> str:
    return f"WITH {_path_acf_sql(g)} SELECT ticker, CAST(lag AS INTEGER) AS lag, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.1), 6) AS q10, round(quantile_cont(rho, 0.9), 6) AS q90 FROM pa GROUP BY ticker, lag"


_KS_SQL = "CASE WHEN ks * ks * n * m / (n + m) < 0.04 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda j : CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * ks * ks * n * m / (n + m)))))) END"
_GARCH = "SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS s2, CAST(0.05 / (1.0::DOUBLE - 0.08 - 0.85) AS DOUBLE) AS next FROM v UNION ALL SELECT f.ticker, v.idx, v.x, f.next, greatest(0.05::DOUBLE + 0.08 * v.x * v.x + 0.85 * f.next, 1e-12) FROM f JOIN v ON v.ticker = f.ticker AND v.idx = f.idx + 1"
_GARCH_PATH = f"WITH RECURSIVE {RETURNS_SQL}, v AS (SELECT ticker, idx, g / 100 AS x FROM returns), f AS ({_GARCH}), path AS (SELECT ticker, idx, x, s2 FROM f WHERE idx > 0)"


def _filter_sql() -> str:
    pdf = [f"exp(-0.5 * x * x / {s * s!r}::DOUBLE) / ({s}::DOUBLE * sqrt(2 * pi()))" for s in SIGMA]
    ahead = ["CASE WHEN f.idx = 0 THEN p{0} ELSE {1} END".format(j + 1, " + ".join(f"p{i + 1} * {MOVE[i][j]}::DOUBLE" for i in range(3))) for j in range(3)]
    joint = ", ".join(f"({ahead[j]}) * {pdf[j]} AS j{j + 1}" for j in range(3))
    return f"""WITH RECURSIVE {RETURNS_SQL}, v AS (SELECT ticker, idx, g / 100 AS x FROM returns), f AS (
SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS idx, CAST(1 / 3.0::DOUBLE AS DOUBLE) AS p1, CAST(1 / 3.0::DOUBLE AS DOUBLE) AS p2, CAST(1 / 3.0::DOUBLE AS DOUBLE) AS p3, CAST(0 AS DOUBLE) AS ll FROM v
UNION ALL SELECT ticker, idx, j1 / (j1 + j2 + j3), j2 / (j1 + j2 + j3), j3 / (j1 + j2 + j3), ln(j1 + j2 + j3) FROM (SELECT f.ticker, v.idx, {joint} FROM f JOIN v ON v.ticker = f.ticker AND v.idx = f.idx + 1))"""


_LOG2 = f"ln(greatest((g / 100 - avg(g / 100) OVER (PARTITION BY ticker)) ** 2, 1e-12)) + {LOG_CHI2}"
_PRED = "(0.9025::DOUBLE * p + 0.09)"
_MEAN = f"((1 - 0.95::DOUBLE) * {LEVEL} + 0.95 * level)"
_JUMPS = f"list_sum(list_transform(range(0, 21), lambda k : exp(k * ln(0.1::DOUBLE) - 0.1 - lgamma(k + 1) - 0.5 * (ln(2 * pi() * (0.81::DOUBLE + k * 3.24)) + (g / 100 - 0.01 + k * 0.05::DOUBLE) ** 2 / (0.81::DOUBLE + k * 3.24)))))"
_NW = "sum(CASE WHEN lag = 0 THEN c ELSE 2 * (1 - lag / (h + 1.0::DOUBLE)) * c END)"

ORACLES = {
    "growth_complete_rows": f"""WITH {BARS_SQL}, h AS (SELECT *, lag(vwap) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM bars WHERE n % 7 > 0)
SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS idx, round(252 * ln(vwap / prev), 6) AS g FROM h WHERE prev IS NOT NULL""",
    "growth_of_vectors": f"WITH {RETURNS_SQL} SELECT ticker, idx, round(g, 6) AS g FROM returns",
    "in_both_parts": f"""WITH {BARS_SQL}, c AS (SELECT min(dt) + INTERVAL 2 YEAR AS cut FROM bars WHERE ticker = 'A'), p AS (SELECT ticker, CASE WHEN dt <= cut THEN 'IS' ELSE 'OOS' END AS part FROM bars, c)
SELECT ticker, part, count(*) AS n FROM p WHERE ticker IN (SELECT ticker FROM p GROUP BY ticker HAVING count(DISTINCT part) = 2) GROUP BY 1, 2""",
    "closed_slice": f"WITH {RETURNS_SQL} SELECT ticker, dt, idx, round(g, 6) AS g FROM returns WHERE dt BETWEEN DATE '1996-02-01' AND DATE '1997-03-15'",
    "zscore_train": f"""WITH {_TRAIN}, m AS (SELECT ticker, avg(g) AS m, stddev_samp(g) AS s FROM train WHERE train GROUP BY ticker)
SELECT ticker, idx, round(CASE WHEN s > 0 THEN (g - m) / s ELSE 0 END, 6) AS z FROM train LEFT JOIN m USING (ticker)""",
    "windows_as_rows": f"""WITH {RETURNS_SQL}, n AS (SELECT ticker, count(*) AS n FROM returns GROUP BY ticker HAVING count(*) >= 20), w AS (SELECT ticker, unnest(range(0, (n - 20) // 15 + 1)) AS w FROM n)
SELECT ticker, w + 1 AS "window", idx - 15 * w AS pos, round(g, 6) AS g FROM w JOIN returns r USING (ticker) WHERE idx BETWEEN 15 * w + 1 AND 15 * w + 20""",
    "windows_and_next": f"""WITH {RETURNS_SQL}, p AS (SELECT ticker, idx, avg(g) OVER w AS mean, lag(g) OVER (PARTITION BY ticker ORDER BY idx) AS last, g FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT ticker, idx, round(mean, 6) AS mean, round(last, 6) AS last, round(g, 6) AS y FROM p WHERE idx > 10""",
    "differenced": f"""WITH {RETURNS_SQL}, d AS (SELECT ticker, idx, g - lag(g) OVER w AS d, abs(g) - abs(lag(g) OVER w) AS a FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY idx))
SELECT ticker, idx, round(d, 6) AS d, round(a, 6) AS d_abs FROM d WHERE d IS NOT NULL""",
    "vendor_fallback": f"WITH {_GROUP_ROWS}, mode_bars AS ({_SCORED}) SELECT ticker, CASE WHEN ticker = 's5' THEN 'second' ELSE 'first' END AS source, count(*) AS n FROM mode_bars WHERE ticker IN (SELECT ticker FROM groups) GROUP BY 1, 2",
    "lookup_skips": f"WITH {_GROUP_ROWS} SELECT ticker, grp FROM groups WHERE ticker NOT IN (SELECT 's' || (l_suppkey % 7) FROM lineitem)",
    "archive_merge": f"""WITH {_MODES} SELECT ticker, CASE WHEN ticker IN ('s0', 's4') THEN 'new' ELSE 'old' END AS archive,
round(CASE WHEN ticker IN ('s0', 's4') THEN avg(g) FILTER (idx <= 100) ELSE avg(g) END, 6) AS mean FROM modes GROUP BY ticker""",
    "rank_reorder": f"""WITH {RETURNS_SQL}, v AS (SELECT ticker, g, row_number() OVER (PARTITION BY ticker ORDER BY g, idx) AS r FROM returns), u AS (SELECT ticker, idx, row_number() OVER (PARTITION BY ticker ORDER BY sin(idx * 12.9898), idx) AS r FROM returns)
SELECT ticker, idx, round(g, 6) AS g FROM u JOIN v USING (ticker, r)""",
    "group_rollup": f"""WITH {_MODES}, {_GROUP_ROWS}, s AS (SELECT ticker, stddev_samp(g) AS score FROM modes GROUP BY ticker)
SELECT grp, count(*) AS n, round(median(score), 5) AS median, arg_min(ticker, score) AS worst, round(min(score), 5) AS worst_score, count(*) FILTER (score < 100) AS failures, round(count(*) FILTER (score < 100) / count(*), 5) AS failure_rate FROM s JOIN groups USING (ticker) GROUP BY grp""",
    "five_stats": f"""WITH {RETURNS_SQL}, s AS (SELECT ticker, count(*) AS n, list(g ORDER BY g) AS s, median(g) AS median, avg(g) AS mean, stddev_samp(g) AS sd FROM returns GROUP BY ticker)
SELECT ticker, n, round(median, 5) AS median, round(s[CAST(greatest(1, least(n, round_even(0.25 * (n + 1), 0))) AS BIGINT)], 5) AS q1, round(s[CAST(greatest(1, least(n, round_even(0.75 * (n + 1), 0))) AS BIGINT)], 5) AS q3, round(mean, 5) AS mean, round(sd, 5) AS sd FROM s""",
    "across_years": f"""WITH {RETURNS_SQL}, y AS (SELECT ticker, year(dt) AS year, stddev_samp(g) AS sd FROM returns GROUP BY 1, 2 HAVING count(*) > 1)
SELECT ticker, count(*) AS folds, round(avg(sd), 5) AS mean, round(stddev_samp(sd), 5) AS sd FROM y GROUP BY ticker""",
    "path_bands": f"""WITH {_boot(20, 50)}, e AS (SELECT ticker, path_id, sum(g) AS x FROM boot GROUP BY 1, 2)
SELECT ticker, round(avg(x), 5) AS mean, {", ".join(f"round(quantile_cont(x, {p}), 5) AS q{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM e GROUP BY ticker""",
    "transition_distance": f"""WITH {BINS_SQL}, s AS (SELECT unnest(range(1, 6)) AS k), {_matrix_sql("ma", "dt < DATE '1996-01-01'")}, {_matrix_sql("mb", "dt >= DATE '1996-01-01'")},
d AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.p, 0) - coalesce(b.p, 0) AS d FROM ma a FULL JOIN mb b ON a.ticker = b.ticker AND a.f = b.f AND a.t = b.t)
SELECT ticker, round(sqrt(sum(d * d)), 6) AS frobenius, round(avg(abs(d)), 6) AS mean_abs FROM d GROUP BY ticker""",
    "acf_bands": f"""WITH {RETURNS_SQL}, m AS (SELECT ticker, avg(g) AS m, var_pop(g) * count(*) AS ss, 2.576 / sqrt(count(*)) AS band FROM returns GROUP BY ticker), l AS (SELECT unnest(range(1, 21)) AS lag),
a AS (SELECT ticker, lag, sum((x.g - m) * (y.g - m)) / any_value(ss) AS rho, any_value(band) AS band FROM returns x JOIN m USING (ticker) JOIN l ON true JOIN returns y USING (ticker) WHERE y.idx = x.idx + lag GROUP BY 1, 2)
SELECT ticker, CAST(lag AS INTEGER) AS lag, round(rho, 6) AS rho, round(band, 6) AS band, abs(rho) > band AS outside FROM a""",
    "lag1_pearson": f"""WITH {RETURNS_SQL}, p AS (SELECT ticker, g, lead(g) OVER (PARTITION BY ticker ORDER BY idx) AS y FROM returns)
SELECT ticker, count(y) AS n, round(corr(g, y), 6) AS rho, round(corr(abs(g), abs(y)), 6) AS rho_abs FROM p GROUP BY ticker""",
    "leverage_asymmetry": f"""WITH {RETURNS_SQL}, p AS (SELECT ticker, g, lead(abs(g)) OVER (PARTITION BY ticker ORDER BY idx) AS y FROM returns), a AS (SELECT ticker, coalesce(avg(y) FILTER (g < 0), 0) AS d, coalesce(avg(y) FILTER (g >= 0), 0) AS u FROM p WHERE y IS NOT NULL GROUP BY ticker)
SELECT ticker, round(d, 5) AS after_falls, round(u, 5) AS after_rises, round(d - u, 5) AS asymmetry FROM a""",
    "residence_times": f"""WITH {BINS_SQL}, s AS (SELECT unnest(range(1, 6)) AS k), {_matrix_sql("ma", "true")} SELECT ticker, CAST(f AS INTEGER) AS state, round(1 / nullif(1 - p, 0), 6) AS steps FROM ma WHERE f = t""",
    "loss_difference": f"""WITH {RETURNS_SQL}, l AS (SELECT ticker, idx - 1 AS idx, g ** 2 / 1e4 - (g - lag(g) OVER (PARTITION BY ticker ORDER BY idx)) ** 2 / 1e4 AS g FROM returns), d AS (SELECT * FROM l WHERE g IS NOT NULL),
m AS (SELECT ticker, count(*) AS n, avg(g) AS m, var_samp(g) AS vi, greatest(1, floor(cbrt(count(*)))) AS h FROM d GROUP BY ticker), k AS (SELECT ticker, n, m, vi, h, unnest(range(0, CAST(h AS BIGINT) + 1)) AS lag FROM m),
c AS (SELECT ticker, any_value(n) AS n, any_value(m) AS m, any_value(vi) AS vi, any_value(h) AS h, lag, sum((x.g - m) * (y.g - m)) / any_value(n) AS c FROM k JOIN d x USING (ticker) JOIN d y USING (ticker) WHERE y.idx = x.idx + lag GROUP BY ticker, lag),
v AS (SELECT ticker, any_value(n) AS n, CAST(any_value(h) AS INTEGER) AS h, any_value(m) AS mean, any_value(vi) AS vi, greatest(0, {_NW}) AS lrv FROM c GROUP BY ticker)
SELECT ticker, n, h, round(mean, 5) AS mean, round(lrv, 5) AS lrv, round(sqrt(vi / n), 5) AS se_indep, round(mean / nullif(sqrt(vi / n), 0), 5) AS z_indep, round(mean / nullif(sqrt(lrv / n), 0), 5) AS z FROM v""",
    "vol_target": f"""WITH {RETURNS_SQL}, v AS (SELECT ticker, idx, g / 100 AS g, var_samp(g / 100) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS variance FROM returns),
w AS (SELECT ticker, idx, least(3, greatest(0.1, 0.15 / sqrt(greatest(variance, 1e-10)))) AS w, g FROM v WHERE idx > 20), p AS (SELECT *, w * g / 252 AS pnl, abs(w - lag(w) OVER o) AS turn FROM w WINDOW o AS (PARTITION BY ticker ORDER BY idx)),
e AS (SELECT *, sum(pnl) OVER o AS eq FROM p WINDOW o AS (PARTITION BY ticker ORDER BY idx)), f AS (SELECT *, max(eq) OVER o - eq AS fall FROM e WINDOW o AS (PARTITION BY ticker ORDER BY idx)),
s AS (SELECT ticker, avg(pnl) * 252 AS r, stddev_samp(pnl) * sqrt(252) AS v, max(fall) AS mdd, sum(turn) * 252 / count(*) AS t, avg(w) AS mean_w FROM f GROUP BY ticker)
SELECT ticker, round(r, 6) AS ann_ret, round(v, 6) AS ann_vol, round(mdd, 6) AS mdd, round(t, 6) AS turnover, round(mean_w, 6) AS mean_w, round(CASE WHEN v > 0 THEN r / v ELSE 0 END, 6) AS sharpe FROM s""",
    "laplace_qq": f"""WITH {RETURNS_SQL}, l AS (SELECT ticker, median(g) AS l FROM returns GROUP BY ticker), b AS (SELECT ticker, any_value(l) AS l, avg(abs(g - l)) AS s FROM returns JOIN l USING (ticker) GROUP BY ticker),
r AS (SELECT ticker, g, row_number() OVER (PARTITION BY ticker ORDER BY g, idx) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM returns), p AS (SELECT *, (i - 0.5::DOUBLE) / n AS p FROM r)
SELECT ticker, CAST(i AS INTEGER) AS i, round(p, 5) AS p, round(l - s * sign(p - 0.5) * ln(1 - 2 * abs(p - 0.5)), 5) AS theoretical, round(g, 5) AS sample FROM p JOIN b USING (ticker)""",
    "path_ks_pass": f"""WITH {_boot(20, 50)}, s AS (SELECT ticker, path_id, 0 AS side, g AS x FROM boot UNION ALL SELECT ticker, path_id, 1, g FROM (SELECT DISTINCT ticker, path_id FROM boot) JOIN returns USING (ticker)),
c AS (SELECT ticker, path_id, x, sum(1 - side) AS p, sum(side) AS q FROM s GROUP BY 1, 2, 3),
e AS (SELECT ticker, path_id, abs(sum(p) OVER o / sum(p) OVER w - sum(q) OVER o / sum(q) OVER w) AS gap, sum(p) OVER w AS n, sum(q) OVER w AS m FROM c WINDOW w AS (PARTITION BY ticker, path_id), o AS (PARTITION BY ticker, path_id ORDER BY x)),
k AS (SELECT ticker, path_id, max(gap) AS ks, CAST(any_value(n) AS DOUBLE) AS n, CAST(any_value(m) AS DOUBLE) AS m FROM e GROUP BY 1, 2)
SELECT ticker, count(*) AS paths, round(avg(ks), 6) AS mean_ks, round(avg(CASE WHEN {_KS_SQL} > 0.05 THEN 1.0 ELSE 0 END), 6) AS pass_rate FROM k GROUP BY ticker""",
    "path_kurtosis": f"""WITH {_boot(20, 50)}, k AS (SELECT ticker, path_id, (kurtosis_pop(g) + 3) * ((count(*) - 1) / count(*)::DOUBLE) ** 2 - 3 AS k FROM boot GROUP BY 1, 2) SELECT ticker, round(avg(k), 5) AS mean_kurtosis FROM k GROUP BY ticker""",
    "path_acf_error": _acf_error_sql("g"),
    "path_acf_error_abs": _acf_error_sql("abs(g)"),
    "path_acf_envelope": _acf_envelope_sql("g"),
    "path_acf_envelope_abs": _acf_envelope_sql("abs(g)"),
    "ljung_box_abs": f"""WITH {RETURNS_SQL}, a AS (SELECT ticker, idx, abs(g) AS g FROM returns), m AS (SELECT ticker, avg(g) AS m, var_pop(g) * count(*) AS ss, count(*) AS n FROM a GROUP BY ticker), l AS (SELECT unnest(range(1, 21)) AS lag),
r AS (SELECT ticker, lag, sum((x.g - m) * (y.g - m)) / any_value(ss) AS rho, any_value(n) AS n FROM a x JOIN m USING (ticker) JOIN l ON true JOIN a y USING (ticker) WHERE y.idx = x.idx + lag GROUP BY 1, 2)
SELECT ticker, round(any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - lag)), 5) AS q FROM r GROUP BY ticker""",
    "pooled_breaches": f"""WITH {_boot(20, 50)}, q AS (SELECT ticker, 0.01::DOUBLE AS alpha, quantile_cont(g, 0.01) AS var FROM boot GROUP BY ticker UNION ALL SELECT ticker, 0.05, quantile_cont(g, 0.05) FROM boot GROUP BY ticker),
b AS (SELECT ticker, alpha, var, CAST(g <= var AS INTEGER) AS b, lag(CAST(g <= var AS INTEGER)) OVER (PARTITION BY ticker, alpha ORDER BY idx) AS a FROM returns JOIN q USING (ticker)),
c AS (SELECT ticker, alpha, any_value(var) AS var, count(*) AS n, CAST(sum(b) AS BIGINT) AS x, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM b GROUP BY ticker, alpha),
p AS (SELECT *, least(1 - 1e-10, greatest(1e-10, x / n)) AS p, n01 / nullif(n00 + n01, 0) AS p01, n11 / nullif(n10 + n11, 0) AS p11, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS pi FROM c),
l AS (SELECT *, -2 * ((n - x) * ln(1 - alpha) + x * ln(alpha) - (n - x) * ln(1 - p) - x * ln(p)) AS lr_uc,
 CASE WHEN n00 + n01 > 0 AND n10 + n11 > 0 AND n01 + n11 > 0 THEN greatest(0, -2 * (CASE WHEN n00 + n10 = 0 THEN 0 ELSE (n00 + n10) * ln(1 - pi) END + (n01 + n11) * ln(pi) - CASE WHEN n00 = 0 THEN 0 ELSE n00 * ln(1 - p01) END - CASE WHEN n01 = 0 THEN 0 ELSE n01 * ln(p01) END - CASE WHEN n10 = 0 THEN 0 ELSE n10 * ln(1 - p11) END - CASE WHEN n11 = 0 THEN 0 ELSE n11 * ln(p11) END)) ELSE 0 END AS lr_ind FROM p)
SELECT ticker, alpha, round(var, 5) AS var, n, x, round(x / n, 5) AS rate, round(lr_uc, 5) AS lr_uc, round({_tail("lr_uc")}, 5) AS p_uc, round(lr_ind, 5) AS lr_ind, round({_tail("lr_ind")}, 5) AS p_ind FROM l""",
    "exact_binomial": f"""WITH {RETURNS_SQL}, q AS (SELECT ticker, idx, g, quantile_cont(g, 0.05) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS var FROM returns),
c AS (SELECT ticker, CAST(count(*) AS INTEGER) AS n, count(*) FILTER (g < var) AS x FROM q WHERE idx > 250 GROUP BY ticker),
p AS (SELECT ticker, n, x, unnest(list_transform(range(0, n + 1), lambda j : exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(0.95)))) AS q, unnest(range(0, n + 1)) AS j FROM c)
SELECT a.ticker, a.n, CAST(a.x AS BIGINT) AS x, round(least(1, sum(a.q) FILTER (a.q <= b.q + 1e-10)), 8) AS p_exact FROM p a JOIN p b ON b.ticker = a.ticker AND b.j = a.x GROUP BY 1, 2, 3""",
    "filtered_historical_var": f"""{_GARCH_PATH}, q AS (SELECT ticker, quantile_disc(x / sqrt(s2), 0.05) AS q FROM path WHERE idx <= 100 GROUP BY ticker)
SELECT ticker, idx, round(q * sqrt(s2), 6) AS var, x < q * sqrt(s2) AS breach FROM path JOIN q USING (ticker) WHERE idx > 100""",
    "garch_variance": f"{_GARCH_PATH} SELECT ticker, idx, round(x, 6) AS x, round(s2, 6) AS s2 FROM path",
    "stochastic_volatility": f"""WITH RECURSIVE {RETURNS_SQL}, v AS (SELECT ticker, idx, {_LOG2} AS y FROM returns), f AS (
SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS idx, CAST({LEVEL} AS DOUBLE) AS level, CAST(0.09 / (1 - 0.95::DOUBLE * 0.95) AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll FROM v UNION ALL
SELECT v.ticker, v.idx, {_MEAN} + {_PRED} / ({_PRED} + 4.9348) * (y - {_MEAN}), (1 - {_PRED} / ({_PRED} + 4.9348)) * {_PRED}, ll - 0.5 * (ln(2 * pi() * ({_PRED} + 4.9348)) + (y - {_MEAN}) ** 2 / ({_PRED} + 4.9348)) FROM f JOIN v ON v.ticker = f.ticker AND v.idx = f.idx + 1)
SELECT ticker, round(ll, 5) AS ll, round(level, 5) AS level FROM f WHERE (ticker, idx) IN (SELECT ticker, max(idx) FROM v GROUP BY ticker)""",
    "jump_diffusion": f"WITH {RETURNS_SQL} SELECT ticker, count(*) AS n, round(sum(ln({_JUMPS})), 5) AS ll FROM returns GROUP BY ticker",
    "held_out_forward": f"{_filter_sql()} SELECT ticker, count(*) AS n, round(sum(ll), 5) AS ll FROM f WHERE idx > 0 GROUP BY ticker",
    "volatility_band": f"{_filter_sql()} SELECT ticker, idx, round(p2 + p3, 6) AS mass FROM f WHERE idx > 0",
    "correlation_reproduction": f"""WITH {_MODES}, {_uniform(20, 50)}, n AS (SELECT ticker, count(*) AS n FROM modes GROUP BY ticker), boot AS (SELECT r.ticker, path_id, t, g FROM u JOIN n ON true JOIN modes r ON r.ticker = n.ticker AND r.idx = CAST(floor(u * n) AS BIGINT) + 1),
o AS (SELECT x.ticker AS a, y.ticker AS b, corr(x.g, y.g) AS rho FROM modes x JOIN modes y ON x.dt = y.dt AND x.ticker < y.ticker GROUP BY 1, 2),
s AS (SELECT path_id, x.ticker AS a, y.ticker AS b, corr(x.g, y.g) AS rho FROM boot x JOIN boot y USING (path_id, t) WHERE x.ticker < y.ticker GROUP BY 1, 2, 3),
e AS (SELECT path_id, sqrt(2 * sum((s.rho - o.rho) ** 2)) AS f, avg(abs(s.rho - o.rho)) AS m FROM s JOIN o USING (a, b) GROUP BY path_id)
SELECT count(*) AS paths, round(avg(f), 6) AS frobenius_mean, round(stddev_samp(f), 6) AS frobenius_sd, round(avg(m), 6) AS mae FROM e""",
    "dominant_share": f"""WITH {_MODES}, y AS (SELECT ticker, year(dt) AS year, sum(g) AS g FROM modes GROUP BY 1, 2), c AS (SELECT year, abs(g) / sum(abs(g)) OVER (PARTITION BY year) AS top, sum(abs(g)) OVER (PARTITION BY year ORDER BY abs(g) DESC, ticker ROWS UNBOUNDED PRECEDING) / sum(abs(g)) OVER (PARTITION BY year) AS cum FROM y)
SELECT CAST(year AS INTEGER) AS year, count(*) AS n, round(max(top), 6) AS top_share, least(count(*), count(*) FILTER (cum < 0.95) + 1) AS n_for_95, least(count(*), count(*) FILTER (cum < 0.99) + 1) AS n_for_99, count(*) FILTER (top > 0.01) AS n_above_1pct FROM c GROUP BY year""",
}
ORACLES["information_criteria"] = _walk(
    "p, ll",
    "CAST(0.1 / 0.15 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll",
    f"0.1::DOUBLE + 0.85 * p * {_PDF[0]} / {_Z}, ll + ln({_Z})",
    "CAST(idx AS DOUBLE) AS n, round(-2 * ll + 12, 5) AS aic, round(-2 * ll + 6 * ln(idx), 5) AS bic, round(-2 * ll + 12 * ln(ln(idx)), 5) AS hqc, round(-2 * ll + 6 * (ln(idx) + 1), 5) AS caic",
)
QUERIES = {n: globals()[n] for n in ORACLES}
