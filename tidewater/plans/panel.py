"""Queries on bars and returns of the lineitem-derived panel, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import stats, timeseries
from tidewater.operators.returns import complete_universe, cumulative_vwap, log_growth, split_at_anniversary
from tidewater.sources.bars import lineitem_bars, ohlc_bars


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_bars(spark, sf_dir)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_growth(bars(spark, sf_dir))


BARS_SQL = """bars AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS dt,
         sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS volume, count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""
RETURNS_SQL = f"""{BARS_SQL},
lagged AS (SELECT *, lag(vwap) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM bars),
returns AS (
  SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS idx, 252 * ln(vwap / prev) AS g
  FROM lagged WHERE prev IS NOT NULL)"""
BINS_SQL = f"""{RETURNS_SQL},
edges AS (SELECT ticker, quantile_cont(g, [0.2, 0.4, 0.6, 0.8]) AS e FROM returns GROUP BY ticker),
binned AS (SELECT r.*, CAST(1 + len(list_filter(e, lambda x : x <= g)) AS INTEGER) AS bin FROM returns r JOIN edges USING (ticker))"""


def panel_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation, population excess kurtosis and 5 % quantile of each ticker's returns."""
    return returns(spark, sf_dir).groupBy("ticker").agg(
        F.count("g").alias("n"),
        F.round(F.avg("g"), 6).alias("mean_g"),
        F.round(F.stddev_samp("g"), 6).alias("sd_g"),
        F.round(F.kurtosis("g"), 6).alias("kurt_g"),
        F.round(F.expr("percentile(g, 0.05)"), 6).alias("q05_g"),
    )


def bars_daily_vwap(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


def bars_ohlc_daily(spark, sf_dir):
    return rounded(ohlc_bars(spark, sf_dir), 9)


def cumulative_vwap_query(spark, sf_dir):
    return rounded(cumulative_vwap(ohlc_bars(spark, sf_dir)))


def log_growth_query(spark, sf_dir):
    return rounded(returns(spark, sf_dir))


def _from(df: DataFrame) -> DataFrame:
    return df.where("dt >= date'1998-01-01' and dt < date'1999-01-01'")


def log_growth_slice_then_lag(spark, sf_dir):
    return rounded(log_growth(_from(bars(spark, sf_dir))))


def log_growth_lag_then_slice(spark, sf_dir):
    return rounded(_from(returns(spark, sf_dir)))


def universe_filter(spark, sf_dir):
    return rounded(complete_universe(bars(spark, sf_dir), "A")).select("ticker", "dt", "vwap")


def split_is_oos(spark, sf_dir):
    return split_at_anniversary(bars(spark, sf_dir), "A", years=4).groupBy("ticker", "part").agg(F.count("*").alias("n"), F.max("dt").alias("last_dt"))


def dedupe_first(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey", F.col("o_orderdate").cast("date")).orderBy("o_orderkey")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", F.col("o_orderdate").cast("date").alias("dt"), "o_orderkey")


def price_reconstruction(spark, sf_dir):
    return rounded(timeseries.prices(returns(spark, sf_dir), 100.0))


def descriptive_stats(spark, sf_dir):
    return rounded(stats.descriptives(returns(spark, sf_dir)), 5)


def acf_profile(spark, sf_dir):
    r = returns(spark, sf_dir).withColumn("a", F.abs("g"))
    raw, absolute = stats.autocorrelations(r, 20), stats.autocorrelations(r, 20, "a").withColumnRenamed("rho", "rho_abs")
    return rounded(raw.join(absolute, ["ticker", "lag"]))


def ljung_box(spark, sf_dir):
    return rounded(stats.ljung_box(returns(spark, sf_dir)), 5)


def laplace_fit(spark, sf_dir):
    return rounded(stats.laplace_fit(returns(spark, sf_dir)))


def weighted_median(spark, sf_dir):
    return rounded(stats.weighted_median(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_extendedprice", "l_quantity"))


def quantile_grid_99(spark, sf_dir):
    return rounded(stats.quantile_grid(returns(spark, sf_dir)))


def _binned(spark, sf_dir):
    return stats.ordinal_bins(returns(spark, sf_dir), 5)


def quantile_bins(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("ticker", "bin").agg(F.count("*").alias("n"))


def transition_matrix(spark, sf_dir):
    return rounded(stats.transition_matrix(_binned(spark, sf_dir), 5))


def state_runs(spark, sf_dir):
    return stats.state_runs(_binned(spark, sf_dir))


def sojourn_moments(spark, sf_dir):
    return rounded(stats.sojourn_moments(stats.state_runs(_binned(spark, sf_dir))), 9)


def within_state_ar1(spark, sf_dir):
    return rounded(stats.within_state_ar1(_binned(spark, sf_dir)), 5)


def em_init_chunks(spark, sf_dir):
    return rounded(stats.initial_states(returns(spark, sf_dir), 4), 5)


def return_histogram(spark, sf_dir):
    return stats.histogram(returns(spark, sf_dir), -1000.0, 50.0)


def anova_f(spark, sf_dir):
    return rounded(stats.one_way_anova(returns(spark, sf_dir)), 7)


def sim_ols(spark, sf_dir):
    return rounded(stats.market_model(returns(spark, sf_dir), "R"), 5)


def corr_matrix(spark, sf_dir):
    return rounded(stats.correlation_pairs(returns(spark, sf_dir)))


def pit_ranks(spark, sf_dir):
    return rounded(stats.probability_ranks(returns(spark, sf_dir)).select("ticker", "idx", "u"), 9)


def rolling_kurtosis(spark, sf_dir):
    return rounded(timeseries.rolling_kurtosis(returns(spark, sf_dir), 60).select("ticker", "idx", "kurt").where("idx >= 60"), 5)


def lagged_rv(spark, sf_dir):
    return rounded(timeseries.lagged_volatility(returns(spark, sf_dir)).select("ticker", "idx", "rv"), 5)


def har_features(spark, sf_dir):
    return rounded(timeseries.har_features(returns(spark, sf_dir)), 3)


def har_sufficient_stats(spark, sf_dir):
    return rounded(timeseries.har_sufficient_statistics(timeseries.har_features(returns(spark, sf_dir))), 3)


def max_drawdown(spark, sf_dir):
    return rounded(timeseries.max_drawdown(returns(spark, sf_dir)))


def aggregational_kurtosis(spark, sf_dir):
    return rounded(timeseries.aggregated_kurtosis(returns(spark, sf_dir), [1, 5, 21]), 5)


def leverage_profile(spark, sf_dir):
    return rounded(timeseries.leverage_profile(returns(spark, sf_dir)))


def leverage_lag1(spark, sf_dir):
    return rounded(timeseries.leverage_lag1(returns(spark, sf_dir)))


def newey_west(spark, sf_dir):
    return rounded(timeseries.newey_west(returns(spark, sf_dir)), 5)


def window_features(spark, sf_dir):
    return rounded(timeseries.window_features(returns(spark, sf_dir)), 5)


_NAMES = """panel_descriptives bars_daily_vwap bars_ohlc_daily log_growth_slice_then_lag log_growth_lag_then_slice universe_filter split_is_oos
dedupe_first price_reconstruction descriptive_stats acf_profile ljung_box laplace_fit weighted_median quantile_grid_99 quantile_bins transition_matrix
state_runs sojourn_moments within_state_ar1 em_init_chunks return_histogram anova_f sim_ols corr_matrix pit_ranks rolling_kurtosis lagged_rv har_features
har_sufficient_stats max_drawdown aggregational_kurtosis leverage_profile leverage_lag1 newey_west window_features""".split()
QUERIES = {n: globals()[n] for n in _NAMES} | {"cumulative_vwap": cumulative_vwap_query, "log_growth": log_growth_query}

_OHLC_SQL = """ohlc AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS dt,
         arg_min(l_extendedprice / l_quantity, k) AS open, max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY 1, 2)"""
_MOMENTS = "count(g) AS n, avg(g) AS mean, stddev_samp(g) AS sd"

ORACLES = {
    "panel_descriptives": f"""WITH {RETURNS_SQL}
SELECT ticker, count(g) AS n, round(avg(g), 6) AS mean_g, round(stddev_samp(g), 6) AS sd_g,
       round(kurtosis_pop(g), 6) AS kurt_g, round(quantile_cont(g, 0.05), 6) AS q05_g
FROM returns GROUP BY ticker""",
    "bars_daily_vwap": f"WITH {BARS_SQL} SELECT ticker, dt, round(vwap, 6) AS vwap, round(volume, 6) AS volume, n FROM bars",
    "bars_ohlc_daily": f"WITH {_OHLC_SQL} SELECT ticker, dt, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, round(volume, 9) AS volume FROM ohlc",
    "cumulative_vwap": f"""WITH {_OHLC_SQL}
SELECT ticker, dt, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS cum_vwap
FROM ohlc WINDOW w AS (PARTITION BY ticker ORDER BY dt)""",
    "log_growth": f"WITH {RETURNS_SQL} SELECT ticker, dt, idx, round(g, 6) AS g FROM returns",
    "log_growth_slice_then_lag": f"""WITH {BARS_SQL}, s AS (SELECT * FROM bars WHERE dt >= DATE '1998-01-01' AND dt < DATE '1999-01-01'),
l AS (SELECT *, lag(vwap) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM s)
SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS idx, round(252 * ln(vwap / prev), 6) AS g FROM l WHERE prev IS NOT NULL""",
    "log_growth_lag_then_slice": f"WITH {RETURNS_SQL} SELECT ticker, dt, idx, round(g, 6) AS g FROM returns WHERE dt >= DATE '1998-01-01' AND dt < DATE '1999-01-01'",
    "universe_filter": f"""WITH {BARS_SQL} SELECT ticker, dt, round(vwap, 6) AS vwap FROM bars
WHERE ticker IN (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) = (SELECT count(*) FROM bars WHERE ticker = 'A'))""",
    "split_is_oos": f"""WITH {BARS_SQL}, c AS (SELECT CAST(min(dt) + INTERVAL 4 YEAR AS DATE) AS cut FROM bars WHERE ticker = 'A')
SELECT ticker, CASE WHEN dt <= cut THEN 'IS' ELSE 'OOS' END AS part, count(*) AS n, max(dt) AS last_dt FROM bars, c GROUP BY 1, 2""",
    "dedupe_first": "SELECT o_custkey, CAST(o_orderdate AS DATE) AS dt, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2",
    "price_reconstruction": f"""WITH {RETURNS_SQL}
SELECT ticker, idx, round(100 * exp(sum(g / 252) OVER (PARTITION BY ticker ORDER BY idx)), 6) AS price FROM returns
UNION ALL SELECT DISTINCT ticker, 0, 100.0 FROM returns""",
    "descriptive_stats": f"""WITH {RETURNS_SQL}, m AS (SELECT ticker, {_MOMENTS} FROM returns GROUP BY ticker),
s AS (SELECT ticker, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd, avg(((g - mean) / sd) ** 3) AS skew, avg(((g - mean) / sd) ** 4) - 3 AS kurt FROM returns JOIN m USING (ticker) GROUP BY ticker)
SELECT ticker, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(n / 6 * (skew ** 2 + kurt ** 2 / 4), 5) AS jb FROM s""",
    "acf_profile": f"""WITH {RETURNS_SQL}, d AS (SELECT ticker, idx, g - avg(g) OVER w AS x, abs(g) - avg(abs(g)) OVER w AS y FROM returns WINDOW w AS (PARTITION BY ticker)),
v AS (SELECT ticker, sum(x * x) AS vx, sum(y * y) AS vy FROM d GROUP BY ticker), k AS (SELECT unnest(range(1, 21)) AS lag)
SELECT a.ticker, CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / any_value(vx), 6) AS rho, round(sum(a.y * b.y) / any_value(vy), 6) AS rho_abs
FROM k JOIN d a ON true JOIN d b ON a.ticker = b.ticker AND b.idx = a.idx + lag JOIN v ON v.ticker = a.ticker GROUP BY 1, 2""",
    "ljung_box": f"""WITH {RETURNS_SQL}, d AS (SELECT ticker, idx, g - avg(g) OVER (PARTITION BY ticker) AS x FROM returns),
v AS (SELECT ticker, sum(x * x) AS vx, count(*) AS n FROM d GROUP BY ticker), k AS (SELECT unnest(range(1, 21)) AS lag),
r AS (SELECT a.ticker, lag, any_value(n) AS n, sum(a.x * b.x) / any_value(vx) AS rho FROM k JOIN d a ON true JOIN d b ON a.ticker = b.ticker AND b.idx = a.idx + lag JOIN v ON v.ticker = a.ticker GROUP BY 1, 2)
SELECT ticker, round(any_value(n) * (any_value(n) + 2) * sum(rho ** 2 / (n - lag)), 5) AS q FROM r GROUP BY ticker""",
    "laplace_fit": f"""WITH {RETURNS_SQL}, m AS (SELECT ticker, median(g) AS location FROM returns GROUP BY ticker)
SELECT ticker, round(any_value(location), 6) AS location, round(avg(abs(g - location)), 6) AS scale FROM returns JOIN m USING (ticker) GROUP BY ticker""",
    "weighted_median": """WITH w AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING) AS upto, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
SELECT l_returnflag, round(min(x), 6) AS weighted_median FROM w WHERE upto >= total / 2 GROUP BY 1""",
    "quantile_grid_99": f"""WITH {RETURNS_SQL}, q AS (SELECT ticker, quantile_cont(g, [{", ".join(str(i / 100) for i in range(1, 100))}]) AS q FROM returns GROUP BY ticker)
SELECT ticker, CAST(i AS INTEGER) AS i, round(q[i], 6) AS q FROM q, (SELECT unnest(range(1, 100)) AS i)""",
    "quantile_bins": f"WITH {BINS_SQL} SELECT ticker, bin, count(*) AS n FROM binned GROUP BY 1, 2",
    "transition_matrix": f"""WITH {BINS_SQL}, s AS (SELECT unnest(range(1, 6)) AS k), grid AS (SELECT DISTINCT ticker, a.k AS f, b.k AS t FROM returns, s a, s b),
p AS (SELECT ticker, bin, lead(bin) OVER (PARTITION BY ticker ORDER BY idx) AS t FROM binned),
c AS (SELECT grid.ticker, grid.f, grid.t, count(p.bin) AS n FROM grid LEFT JOIN p ON p.ticker = grid.ticker AND p.bin = grid.f AND p.t = grid.t GROUP BY 1, 2, 3)
SELECT ticker, CAST(f AS INTEGER) AS from_state, CAST(t AS INTEGER) AS to_state, n, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0.2 END, 6) AS p FROM c WINDOW w AS (PARTITION BY ticker, f)""",
}
_RUNS_SQL = f"""{BINS_SQL}, marked AS (SELECT *, CASE WHEN bin = lag(bin) OVER (PARTITION BY ticker ORDER BY idx) THEN 0 ELSE 1 END AS new FROM binned),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY idx) AS run FROM marked),
runs AS (SELECT ticker, CAST(run AS BIGINT) AS run, any_value(bin) AS state, count(*) AS length FROM numbered GROUP BY 1, 2)"""
ORACLES |= {
    "state_runs": f"WITH {_RUNS_SQL} SELECT * FROM runs",
    "sojourn_moments": f"""WITH {_RUNS_SQL}, m AS (SELECT ticker, state, count(*) AS n_runs, avg(length) AS m, var_samp(length) AS v, min(length) AS d, max(length) AS longest, sum(ln(length)) AS s FROM runs GROUP BY 1, 2)
SELECT ticker, state, n_runs, round(m, 9) AS mean_len, round(v, 9) AS var_len, round(CASE WHEN n_runs >= 3 AND v > m THEN greatest(0.1, m * m / nullif(v - m, 0)) END, 9) AS nb_r,
 round(CASE WHEN n_runs >= 3 AND v > m THEN least(1 - 1e-6, greatest(1e-6, m / v)) ELSE 1 / greatest(m, 1) END, 9) AS nb_p,
 round(least(5.0, greatest(0.3, CASE WHEN s - n_runs * ln(d) > 1e-12 THEN n_runs / (s - n_runs * ln(d)) ELSE 1.5 END)), 9) AS pareto_alpha, greatest(2 * longest, 100) AS d_max FROM m""",
    "within_state_ar1": f"""WITH {BINS_SQL}, p AS (SELECT ticker, bin, g, lag(g) OVER w AS x, lag(bin) OVER w AS b FROM binned WINDOW w AS (PARTITION BY ticker ORDER BY idx))
SELECT ticker, bin AS state, count(*) AS n, round(least(0.999, greatest(-0.999, regr_slope(g, x))), 5) AS phi, round(regr_intercept(g, x), 5) AS intercept FROM p WHERE b = bin GROUP BY 1, 2""",
    "em_init_chunks": f"""WITH {RETURNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY g, idx) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM returns),
c AS (SELECT *, CAST(least((r - 1) // greatest(1, n // 4), 3) + 1 AS INTEGER) AS state FROM r)
SELECT ticker, state, round(avg(g), 5) AS mu, round(greatest(coalesce(stddev_samp(g), 1e-6), 1e-6), 5) AS sigma, count(*) AS n FROM c GROUP BY 1, 2""",
    "return_histogram": f"WITH {RETURNS_SQL} SELECT ticker, CAST(floor((g + 1000) / 50) AS INTEGER) AS bucket, count(*) AS n FROM returns GROUP BY 1, 2",
    "anova_f": f"""WITH {RETURNS_SQL}, t AS (SELECT ticker, count(*) AS n, avg(g) AS m FROM returns GROUP BY ticker), a AS (SELECT avg(g) AS grand, count(*) AS n_all FROM returns),
b AS (SELECT sum(n * (m - grand) ** 2) AS between_, count(*) AS k, any_value(n_all) AS n_all FROM t, a), w AS (SELECT sum((g - m) ** 2) AS within_ FROM returns JOIN t USING (ticker))
SELECT k, n_all, round((between_ / (k - 1)) / (within_ / (n_all - k)), 7) AS f, round(between_ / (between_ + within_), 7) AS eta2 FROM b, w""",
    "sim_ols": f"""WITH {RETURNS_SQL}, p AS (SELECT a.ticker, a.g AS y, m.g AS x FROM returns a JOIN returns m ON a.dt = m.dt AND m.ticker = 'R' WHERE a.ticker <> 'R')
SELECT ticker, count(*) AS n, round(regr_intercept(y, x), 5) AS alpha, round(regr_slope(y, x), 5) AS beta, round(regr_r2(y, x), 5) AS r2,
       round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2)), 5) AS resid_sd FROM p GROUP BY ticker""",
    "corr_matrix": f"WITH {RETURNS_SQL} SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, round(corr(x.g, y.g), 6) AS rho FROM returns x JOIN returns y ON x.dt = y.dt AND x.ticker < y.ticker GROUP BY 1, 2",
    "pit_ranks": f"WITH {RETURNS_SQL} SELECT ticker, idx, round(row_number() OVER (PARTITION BY ticker ORDER BY g, idx) / (count(*) OVER (PARTITION BY ticker) + 1), 9) AS u FROM returns",
    "rolling_kurtosis": f"WITH {RETURNS_SQL}, k AS (SELECT ticker, idx, kurtosis_pop(g) OVER (PARTITION BY ticker ORDER BY idx ROWS 59 PRECEDING) AS k FROM returns) SELECT ticker, idx, round(k, 5) AS kurt FROM k WHERE idx >= 60",
    "lagged_rv": f"WITH {RETURNS_SQL} SELECT ticker, idx, round(coalesce(sqrt(avg(g * g) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), sqrt(avg(g * g) OVER (PARTITION BY ticker))), 5) AS rv FROM returns",
    "max_drawdown": f"""WITH {RETURNS_SQL}, c AS (SELECT ticker, idx, sum(g / 252) OVER (PARTITION BY ticker ORDER BY idx) AS c FROM returns),
t AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY ticker ORDER BY idx)) AS top FROM c) SELECT ticker, round(max(top - c), 6) AS max_drawdown FROM t GROUP BY ticker""",
    "aggregational_kurtosis": f"""WITH {RETURNS_SQL}, h AS (SELECT unnest([1, 5, 21]) AS h), b AS (SELECT ticker, h, (idx - 1) // h AS k, sum(g) AS s, count(*) AS n FROM returns, h GROUP BY 1, 2, 3 HAVING count(*) = h)
SELECT ticker, h, count(*) AS blocks, round(CASE WHEN count(*) >= 5 THEN kurtosis_pop(s) END, 5) AS kurt FROM b GROUP BY 1, 2""",
    "leverage_profile": f"""WITH {RETURNS_SQL}, k AS (SELECT unnest(range(1, 21)) AS lag)
SELECT a.ticker, CAST(lag AS INTEGER) AS lag, round(corr(a.g, b.g * b.g), 6) AS rho FROM k JOIN returns a ON true JOIN returns b ON a.ticker = b.ticker AND b.idx = a.idx + lag GROUP BY 1, 2""",
    "leverage_lag1": f"WITH {RETURNS_SQL}, p AS (SELECT ticker, g, abs(lead(g) OVER (PARTITION BY ticker ORDER BY idx)) AS y FROM returns) SELECT ticker, round(corr(g, y), 6) AS rho FROM p WHERE y IS NOT NULL GROUP BY ticker",
    "newey_west": f"""WITH {RETURNS_SQL}, d AS (SELECT ticker, idx, g - avg(g) OVER w AS x, avg(g) OVER w AS mean, count(*) OVER w AS n, CAST(greatest(1, floor(cbrt(count(*) OVER w))) AS INTEGER) AS h FROM returns WINDOW w AS (PARTITION BY ticker)),
k AS (SELECT unnest(range(1, 40)) AS k), c AS (SELECT a.ticker, k, any_value(1 - k / (a.h + 1)) * sum(a.x * b.x) / any_value(a.n) AS c FROM k JOIN d a ON k <= a.h JOIN d b ON a.ticker = b.ticker AND b.idx = a.idx + k GROUP BY 1, 2),
z AS (SELECT ticker, any_value(n) AS n, any_value(h) AS h, any_value(mean) AS mean, sum(x * x) / any_value(n) AS g0 FROM d GROUP BY ticker), l AS (SELECT z.ticker, any_value(n) AS n, any_value(h) AS h, any_value(mean) AS mean, greatest(0, any_value(g0) + 2 * sum(c)) AS lrv FROM z JOIN c USING (ticker) GROUP BY 1)
SELECT ticker, n, h, round(mean, 5) AS mean, round(lrv, 5) AS lrv, round(mean / nullif(sqrt(lrv / n), 0), 5) AS z FROM l""",
    "har_features": f"""WITH {RETURNS_SQL}, f AS (SELECT ticker, idx, g * g AS rv, lag(g * g) OVER w AS rv_d, avg(g * g) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rv_w, avg(g * g) OVER (w ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS rv_m FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY idx))
SELECT ticker, idx, round(rv, 3) AS rv, round(rv_d, 3) AS rv_d, round(rv_w, 3) AS rv_w, round(rv_m, 3) AS rv_m FROM f WHERE idx > 22""",
    "har_sufficient_stats": f"""WITH {RETURNS_SQL}, f AS (SELECT ticker, idx, g * g AS rv, lag(g * g) OVER w AS rv_d, avg(g * g) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rv_w, avg(g * g) OVER (w ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS rv_m FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
l AS (SELECT ticker, ln(rv) AS y, ln(rv_d) AS d, ln(rv_w) AS w, ln(rv_m) AS m FROM f WHERE idx > 22 AND rv > 0 AND rv_d > 0)
SELECT ticker, count(*) AS n, round(sum(y), 3) AS s_rv, round(sum(d), 3) AS s_rv_d, round(sum(w), 3) AS s_rv_w, round(sum(m), 3) AS s_rv_m, round(sum(d * d), 3) AS s_rv_d_rv_d, round(sum(d * w), 3) AS s_rv_d_rv_w,
 round(sum(d * m), 3) AS s_rv_d_rv_m, round(sum(w * w), 3) AS s_rv_w_rv_w, round(sum(w * m), 3) AS s_rv_w_rv_m, round(sum(m * m), 3) AS s_rv_m_rv_m, round(sum(d * y), 3) AS s_rv_d_y, round(sum(w * y), 3) AS s_rv_w_y, round(sum(m * y), 3) AS s_rv_m_y FROM l GROUP BY ticker""",
    "window_features": f"""WITH {RETURNS_SQL}, p AS (SELECT ticker, idx, g, lead(g) OVER o AS y, lead(g, 5) OVER o AS y5, sum(g) OVER o AS c FROM returns WINDOW o AS (PARTITION BY ticker ORDER BY idx)),
f AS (SELECT ticker, idx, count(*) OVER w AS n, avg(g) OVER w AS m, avg(g * g) OVER w AS m2, avg(g ** 3) OVER w AS m3, avg(g ** 4) OVER w AS m4, stddev_samp(g) OVER w + 1e-12 AS sd, max(g) OVER w AS hi, min(g) OVER w AS lo, max(c) OVER w - min(c) OVER w AS cum_range,
  corr(g, y) OVER v AS ac1, corr(abs(g), abs(y)) OVER v AS ac1_abs, corr(abs(g), abs(y5)) OVER u AS ac5_abs
 FROM p WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), v AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING), u AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
SELECT ticker, idx, round(m, 5) AS mean, round(sd, 5) AS sd, round((m3 - 3 * m * m2 + 2 * m ** 3) / sd ** 3, 5) AS skew, round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / sd ** 4 - 3, 5) AS kurt, round(hi, 5) AS hi, round(lo, 5) AS lo, round(cum_range, 5) AS cum_range,
 round(ac1, 5) AS ac1, round(ac1_abs, 5) AS ac1_abs, round(ac5_abs, 5) AS ac5_abs FROM f WHERE n = 20""",
}
