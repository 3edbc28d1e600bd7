"""Queries on distances, risk, fixed-parameter recursions and hashed simulations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import dependence, fidelity, pooled, recursions, risk, simulate, stats
from tidewater.operators.dependence import previous_value, vendor_overlap
from tidewater.plans.panel import BARS_SQL, BINS_SQL, RETURNS_SQL, bars, returns, rounded


#: Fixed: the grid of (alpha, beta) that GARCH fits start from.
FOLDS = 6
GRID = [0.02, 0.05, 0.10, 0.15], [0.70, 0.80, 0.85, 0.90]


def _scaled(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("g", F.col("g") / 100)


def ks_two_sample(spark, sf_dir):
    out = fidelity.ks_distance(fidelity.ticker_pairs(returns(spark, sf_dir)), "a", "b")
    return rounded(out.withColumn("p_value", fidelity.ks_p_value(F.col("ks"), F.col("n"), F.col("m"))), 8)


def wasserstein1(spark, sf_dir):
    return rounded(fidelity.wasserstein1(fidelity.ticker_pairs(returns(spark, sf_dir)), "a", "b"))


def hellinger(spark, sf_dir):
    return rounded(fidelity.hellinger(fidelity.ticker_pairs(returns(spark, sf_dir)), "a", "b"), 8)


def var_es(spark, sf_dir):
    return rounded(risk.var_es(returns(spark, sf_dir), 0.05))


def _breaches(spark, sf_dir):
    return risk.rolling_breaches(returns(spark, sf_dir), 0.05, 250)


def var_breaches(spark, sf_dir):
    return rounded(_breaches(spark, sf_dir))


def coverage_tests(spark, sf_dir):
    return rounded(risk.coverage_tests(_breaches(spark, sf_dir), 0.05, "ticker"))


def garch_ll_fold(spark, sf_dir):
    held = recursions.series(_scaled(spark, sf_dir))
    return rounded(recursions.garch_likelihood(held, "0.05D", "0.08D", "0.85D"))


def gjr_fold(spark, sf_dir):
    return rounded(recursions.gjr_likelihood(recursions.series(_scaled(spark, sf_dir)), "0.05D", "0.04D", "0.08D", "0.85D"))


def egarch_fold(spark, sf_dir):
    return rounded(recursions.egarch_likelihood(recursions.series(_scaled(spark, sf_dir)), "0.02D", "0.1D", "-0.05D", "0.9D", "1.4D"))


def forward_filter_fold(spark, sf_dir):
    return rounded(recursions.two_state_filter(recursions.series(_scaled(spark, sf_dir)), (0.95, 0.9), (0.9, 1.6)))


def caviar_path(spark, sf_dir):
    return rounded(recursions.caviar_path(recursions.series(_scaled(spark, sf_dir)), "-0.1D", "0.9D", "-0.1D", "-1.9D", 0.05))


def garch_grid(spark, sf_dir):
    r = _scaled(spark, sf_dir)
    held = recursions.series(r).join(r.groupBy("ticker").agg(F.var_samp("g").alias("v2"), F.avg("g").alias("m")), "ticker")
    return rounded(recursions.garch_grid(held, "v2", *GRID, mu="m"), 5)


def bootstrap_paths_hash(spark, sf_dir):
    return rounded(simulate.bootstrap_paths(returns(spark, sf_dir), 20, 50))


def laplace_paths_hash(spark, sf_dir):
    return rounded(simulate.laplace_paths(stats.laplace_fit(returns(spark, sf_dir)), 20, 50), 5)


def markov_walk_hash(spark, sf_dir):
    return simulate.markov_walk(stats.transition_matrix(stats.ordinal_bins(returns(spark, sf_dir), 5), 5), 10, 40)


def crps_ensemble(spark, sf_dir):
    """Every ticker's first 30 steps under 40 paths of its own."""
    observed = returns(spark, sf_dir).select("ticker", F.col("idx").alias("t"), F.col("g").alias("y"))
    return rounded(fidelity.crps(simulate.bootstrap_paths(returns(spark, sf_dir), 40, 30), observed), 5)


def quantile_coverage(spark, sf_dir):
    return rounded(pooled.quantile_coverage(simulate.bootstrap_paths(returns(spark, sf_dir), 40, 200), returns(spark, sf_dir)))


def auc_tied_rank(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return rounded(fidelity.auc(rows, "s", "p"), 9)


def kendall_tau(spark, sf_dir):
    return rounded(dependence.kendall_tau(returns(spark, sf_dir)), 9)


def asof_previous(spark, sf_dir):
    """Every ticker's last price before each order date."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("dt")).distinct()
    held = bars(spark, sf_dir).select("ticker", "dt", "vwap")
    return rounded(previous_value(held.select("ticker").distinct().join(days), held, "dt", "vwap"))


def vendor_overlap_diff(spark, sf_dir):
    """Every pair of tickers, taken as two sources of one series."""
    b = bars(spark, sf_dir).select("ticker", "dt", "vwap")
    names = b.select("ticker").distinct()
    pairs = names.select(F.col("ticker").alias("a")).join(names.select(F.col("ticker").alias("b")), F.col("a") < F.col("b")).withColumn("series", F.concat_ws("-", "a", "b"))
    side = lambda c: b.join(pairs.select(F.col(c).alias("ticker"), "series"), "ticker")
    return rounded(vendor_overlap(side("a"), side("b")), 7)


def walk_forward_folds(spark, sf_dir):
    """Statistics of three years of training and one of testing, by the six folds."""
    rows = returns(spark, sf_dir).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    year = F.year("dt") - 1995 - F.col("fold")
    rows = rows.where((year >= 0) & (year < 4)).withColumn("part", F.when(year < 3, "train").otherwise("test"))
    return rounded(rows.groupBy("fold", "ticker", "part").agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd")), 5)


_NAMES = """ks_two_sample wasserstein1 hellinger var_es var_breaches coverage_tests garch_ll_fold gjr_fold egarch_fold forward_filter_fold caviar_path garch_grid
bootstrap_paths_hash laplace_paths_hash markov_walk_hash crps_ensemble quantile_coverage auc_tied_rank kendall_tau asof_previous vendor_overlap_diff walk_forward_folds""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_PAIRS = f"""{RETURNS_SQL}, n AS (SELECT DISTINCT ticker FROM returns), pairs AS (SELECT x.ticker AS a, y.ticker AS b FROM n x JOIN n y ON x.ticker < y.ticker),
s AS (SELECT a, b, 0 AS side, g AS x FROM pairs JOIN returns ON ticker = a UNION ALL SELECT a, b, 1, g FROM pairs JOIN returns ON ticker = b)"""
_BREACH = f"""{RETURNS_SQL}, q AS (SELECT ticker, idx, g, quantile_cont(g, 0.05) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING) AS var FROM returns),
breaches AS (SELECT ticker, idx, var, g < var AS breach FROM q WHERE idx > 250)"""


def _uniform(paths: int, steps: int, name: str = "") -> str:
    m = 2147483647
    return f"""{name}h0 AS (SELECT p.path_id, t.t, (p.path_id * 1103515245 + t.t * 69069069 + {40692 + 12345}) % {m} AS h FROM (SELECT unnest(range(1, {paths + 1})) AS path_id) p, (SELECT unnest(range(1, {steps + 1})) AS t) t),
{name}h1 AS (SELECT path_id, t, (h * h + h * 48271 + 7) % {m} AS h FROM {name}h0), {name}h2 AS (SELECT path_id, t, (h * 16807 + t) % {m} AS h FROM {name}h1),
{name}u AS (SELECT path_id, t, ((h * h + h * 69621 + 11) % {m} + 0.5::DOUBLE) / {m}::DOUBLE AS u FROM {name}h2)"""


def _boot(paths: int, steps: int) -> str:
    return f"""{RETURNS_SQL}, {_uniform(paths, steps)}, n AS (SELECT ticker, count(*) AS n FROM returns GROUP BY ticker),
boot AS (SELECT r.ticker, path_id, t, g FROM u JOIN n ON true JOIN returns r ON r.ticker = n.ticker AND r.idx = CAST(floor(u * n) AS BIGINT) + 1)"""


def _walk(state: str, start: str, step: str, end: str, x: str = "g / 100") -> str:
    """A recursion over each ticker's steps. start and step give the columns named in state; step may use them and x."""
    return f"""WITH RECURSIVE {RETURNS_SQL}, v AS (SELECT ticker, idx, {x} AS x FROM returns), f AS (
SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS idx, {start} FROM v UNION ALL SELECT f.ticker, v.idx, {step} FROM f JOIN v ON v.ticker = f.ticker AND v.idx = f.idx + 1)
SELECT ticker, {end} FROM f WHERE (ticker, idx) IN (SELECT ticker, max(idx) FROM v GROUP BY ticker)"""


def _tail(x: str) -> str:
    z = f"sqrt(greatest({x}, 0) / 2)"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z}))"
    return f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-greatest({x}, 0) / 2)"


_LL = "ll - 0.5 * (ln(2 * pi()) + ln(greatest(s2, 1e-12)) + x * x / greatest(s2, 1e-12))"
_PDF = ["exp(-0.5 * x * x / {0}) / (sqrt({0}) * sqrt(2 * pi()))".format(v) for v in ("0.81", "2.56")]
_Z = f"(p * {_PDF[0]} + (1 - p) * {_PDF[1]})"
ORACLES = {
    "ks_two_sample": f"""WITH {_PAIRS}, c AS (SELECT a, b, x, sum(1 - side) AS p, sum(side) AS q FROM s GROUP BY 1, 2, 3),
e AS (SELECT a, b, abs(sum(p) OVER o / sum(p) OVER w - sum(q) OVER o / sum(q) OVER w) AS gap, sum(p) OVER w AS n, sum(q) OVER w AS m FROM c WINDOW w AS (PARTITION BY a, b), o AS (PARTITION BY a, b ORDER BY x)),
k AS (SELECT a, b, max(gap) AS ks, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m FROM e GROUP BY 1, 2)
SELECT a, b, round(ks, 8) AS ks, n, m, round(least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda j : CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * ks * ks * n * m / (n + m)))))), 8) AS p_value FROM k""",
    "wasserstein1": f"""WITH {_PAIRS}, r AS (SELECT a, b, side, x, row_number() OVER (PARTITION BY a, b, side ORDER BY x) AS r, count(*) OVER (PARTITION BY a, b, side) AS n FROM s),
z AS (SELECT a, b, max(n) FILTER (side = 0) AS n0, max(n) FILTER (side = 1) AS n1 FROM r GROUP BY 1, 2), k AS (SELECT a, b, n0, n1, unnest(range(1, least(n0, n1) + 1)) AS k FROM z),
i AS (SELECT a, b, CAST(round_even(k * n0 / least(n0, n1), 0) AS BIGINT) AS r0, CAST(round_even(k * n1 / least(n0, n1), 0) AS BIGINT) AS r1 FROM k)
SELECT i.a, i.b, round(avg(abs(x.x - y.x)), 6) AS w1 FROM i JOIN r x ON x.a = i.a AND x.b = i.b AND x.side = 0 AND x.r = r0 JOIN r y ON y.a = i.a AND y.b = i.b AND y.side = 1 AND y.r = r1 GROUP BY 1, 2""",
    "hellinger": f"""WITH {_PAIRS}, e AS (SELECT *, min(x) OVER w - 10 AS lo, max(x) OVER w + 10 AS hi FROM s WINDOW w AS (PARTITION BY a, b)),
c AS (SELECT a, b, least(floor((x - lo) / ((hi - lo) / 100)), 99) AS k, sum(1 - side) AS p, sum(side) AS q FROM e GROUP BY 1, 2, 3),
d AS (SELECT a, b, (sqrt(p / sum(p) OVER w) - sqrt(q / sum(q) OVER w)) ** 2 AS d FROM c WINDOW w AS (PARTITION BY a, b)) SELECT a, b, round(sqrt(sum(d) / 2), 8) AS hellinger FROM d GROUP BY 1, 2""",
    "var_es": f"""WITH {RETURNS_SQL}, q AS (SELECT ticker, quantile_cont(g, 0.05) AS var FROM returns GROUP BY ticker)
SELECT ticker, round(any_value(var), 6) AS var, round(avg(g) FILTER (g <= var), 6) AS es FROM returns JOIN q USING (ticker) GROUP BY ticker""",
    "var_breaches": f"WITH {_BREACH} SELECT ticker, idx, round(var, 6) AS var, breach FROM breaches",
    "coverage_tests": f"""WITH {_BREACH}, b AS (SELECT ticker, CAST(breach AS INTEGER) AS b, lag(CAST(breach AS INTEGER)) OVER (PARTITION BY ticker ORDER BY idx) AS a FROM breaches),
c AS (SELECT ticker, count(*) AS n, CAST(sum(b) AS BIGINT) AS x, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM b GROUP BY ticker),
p AS (SELECT *, least(1 - 1e-10, greatest(1e-10, x / n)) AS p, n01 / nullif(n00 + n01, 0) AS p01, n11 / nullif(n10 + n11, 0) AS p11, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS pi FROM c),
l AS (SELECT *, -2 * ((n - x) * ln(0.95) + x * ln(0.05) - (n - x) * ln(1 - p) - x * ln(p)) AS lr_uc,
 CASE WHEN n00 + n01 > 0 AND n10 + n11 > 0 AND n01 + n11 > 0 THEN greatest(0, -2 * (CASE WHEN n00 + n10 = 0 THEN 0 ELSE (n00 + n10) * ln(1 - pi) END + (n01 + n11) * ln(pi) - CASE WHEN n00 = 0 THEN 0 ELSE n00 * ln(1 - p01) END - CASE WHEN n01 = 0 THEN 0 ELSE n01 * ln(p01) END - CASE WHEN n10 = 0 THEN 0 ELSE n10 * ln(1 - p11) END - CASE WHEN n11 = 0 THEN 0 ELSE n11 * ln(p11) END)) ELSE 0 END AS lr_ind FROM p)
SELECT ticker, n, x, n00, n01, n10, n11, round(lr_uc, 6) AS lr_uc, round(lr_ind, 6) AS lr_ind, round({_tail("lr_uc")}, 6) AS p_uc, round({_tail("lr_ind")}, 6) AS p_ind, round(lr_uc + lr_ind, 6) AS lr_cc, round(exp(-(lr_uc + lr_ind) / 2), 6) AS p_cc FROM l""",
    "garch_ll_fold": _walk("s2, ll", "CAST(0.05 / (1.0::DOUBLE - 0.08 - 0.85) AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS ll", f"0.05::DOUBLE + 0.08 * x * x + 0.85 * greatest(s2, 1e-12), {_LL}", "round(ll, 6) AS ll, round(s2, 6) AS s2"),
    "garch_grid": f"""WITH RECURSIVE {RETURNS_SQL}, v AS (SELECT ticker, idx, g / 100 - avg(g / 100) OVER (PARTITION BY ticker) AS x, var_samp(g / 100) OVER (PARTITION BY ticker) AS v2 FROM returns),
p AS (SELECT unnest({[float(a) for a in GRID[0]]}) AS alpha), q AS (SELECT unnest({[float(b) for b in GRID[1]]}) AS beta), f AS (
SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS idx, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, v2 * (1 - alpha::DOUBLE - beta::DOUBLE) AS omega, v2 AS s2, CAST(0 AS DOUBLE) AS ll FROM v, p, q WHERE alpha + beta < 0.999
UNION ALL SELECT f.ticker, v.idx, alpha, beta, omega, omega + alpha * x * x + beta * greatest(s2, 1e-12), {_LL} FROM f JOIN v ON v.ticker = f.ticker AND v.idx = f.idx + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ll DESC, alpha DESC, beta DESC) AS r FROM f WHERE (ticker, idx) IN (SELECT ticker, max(idx) FROM v GROUP BY ticker))
SELECT ticker, alpha, beta, round(omega, 5) AS omega, round(ll, 5) AS ll FROM e WHERE r = 1""",
    "gjr_fold": _walk("s2, ll", "CAST(0.05 / (1.0::DOUBLE - 0.04 - 0.04 - 0.85) AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS ll", f"0.05::DOUBLE + (0.04 + CASE WHEN x < 0 THEN 0.08 ELSE 0 END) * x * x + 0.85 * greatest(s2, 1e-12), {_LL}", "round(ll, 6) AS ll, round(s2, 6) AS s2"),
    "egarch_fold": _walk("h, ll", "CAST(ln(1.4) AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS ll", "least(30, greatest(-30, 0.02::DOUBLE + 0.9 * h + 0.1 * (abs(x / exp(h / 2)) - sqrt(2 / pi())) - 0.05 * x / exp(h / 2))), ll - 0.5 * (ln(2 * pi()) + h + (x / exp(h / 2)) ** 2)", "round(ll, 6) AS ll, round(exp(h), 6) AS s2"),
    "forward_filter_fold": _walk("p, ll", "CAST(0.1 / 0.15 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS ll", f"0.1::DOUBLE + 0.85 * p * {_PDF[0]} / {_Z}, ll + ln({_Z})", "round(ll, 6) AS ll, round(p, 6) AS p"),
    "caviar_path": _walk("q, loss, hits, n", "CAST(-1.9 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS loss, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS n", "-0.1::DOUBLE + 0.9 * q - 0.1 * abs(x), loss + (0.05 - CASE WHEN x < q THEN 1 ELSE 0 END) * (x - q), hits + CASE WHEN x < q THEN 1 ELSE 0 END, n + 1", "round(loss / n, 6) AS loss, round(q, 6) AS q_next, hits AS breaches"),
    "bootstrap_paths_hash": f"WITH {_boot(20, 50)} SELECT ticker, path_id, t, round(g, 6) AS g FROM boot",
    "laplace_paths_hash": f"""WITH {RETURNS_SQL}, {_uniform(20, 50)}, m AS (SELECT ticker, median(g) AS l FROM returns GROUP BY ticker), b AS (SELECT ticker, any_value(l) AS l, avg(abs(g - l)) AS s FROM returns JOIN m USING (ticker) GROUP BY ticker)
SELECT ticker, path_id, t, round(l - s * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)), 5) AS g FROM u, b""",
    "markov_walk_hash": f"""WITH RECURSIVE {BINS_SQL}, {_uniform(10, 40)}, q AS (SELECT ticker, bin, lead(bin) OVER (PARTITION BY ticker ORDER BY idx) AS t FROM binned),
c AS (SELECT ticker, bin AS f, t, count(*) AS n FROM q WHERE t IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT ticker, f, t, sum(n) OVER (PARTITION BY ticker, f ORDER BY t) / sum(n) OVER (PARTITION BY ticker, f) AS c FROM c),
edges5 AS (SELECT ticker, f, list(c ORDER BY t) AS c FROM p GROUP BY 1, 2), w AS (SELECT DISTINCT ticker, path_id, CAST(0 AS BIGINT) AS t, 1 AS state FROM edges5, u
UNION ALL SELECT w.ticker, w.path_id, u.t, CAST(least(5, 1 + len(list_filter(e.c, lambda x : x <= u.u))) AS INTEGER) FROM w JOIN u ON u.path_id = w.path_id AND u.t = w.t + 1 JOIN edges5 e ON e.ticker = w.ticker AND e.f = w.state)
SELECT ticker, path_id, CAST(t AS INTEGER) AS t, state FROM w""",
    "crps_ensemble": f"""WITH {_boot(40, 30)}, o AS (SELECT ticker, idx AS t, g AS y FROM returns), r AS (SELECT ticker, t, g, y, row_number() OVER (PARTITION BY ticker, t ORDER BY g, path_id) AS i, count(*) OVER (PARTITION BY ticker, t) AS n FROM boot JOIN o USING (ticker, t))
SELECT ticker, t, round(avg(abs(g - y)) - sum(g * (2 * i - n - 1)) / (any_value(n) * (any_value(n) - 1)), 5) AS crps FROM r GROUP BY ticker, t""",
    "quantile_coverage": f"""WITH {_boot(40, 200)}, i AS (SELECT unnest(range(1, 100)) AS i), q AS (SELECT ticker, path_id, quantile_cont(g, [{", ".join(str(i / 100) for i in range(1, 100))}]) AS q FROM boot GROUP BY 1, 2),
b AS (SELECT ticker, i, quantile_cont(q[i], 0.05) AS lo, quantile_cont(q[i], 0.95) AS hi FROM q, i GROUP BY 1, 2), o AS (SELECT ticker, quantile_cont(g, [{", ".join(str(i / 100) for i in range(1, 100))}]) AS o FROM returns GROUP BY ticker)
SELECT ticker, round(avg(CAST(o[i] >= lo AND o[i] <= hi AS DOUBLE)), 6) AS coverage FROM b JOIN o USING (ticker) GROUP BY ticker""",
    "auc_tied_rank": """WITH r AS (SELECT l_returnflag = 'R' AS p, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem)
SELECT round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 9) AS auc FROM r""",
    "asof_previous": f"""WITH {BARS_SQL}, d AS (SELECT DISTINCT ticker, CAST(o_orderdate AS DATE) AS dt FROM orders, (SELECT DISTINCT ticker FROM bars))
SELECT d.ticker, d.dt, round(arg_max(a.vwap, a.dt), 6) AS vwap FROM d LEFT JOIN bars a ON a.ticker = d.ticker AND a.dt < d.dt GROUP BY d.ticker, d.dt""",
    "vendor_overlap_diff": f"""WITH {BARS_SQL}, j AS (SELECT x.ticker || '-' || y.ticker AS series, (x.vwap - y.vwap) / y.vwap AS d, ln(x.vwap / lag(x.vwap) OVER w) - ln(y.vwap / lag(y.vwap) OVER w) AS r FROM bars x JOIN bars y ON x.dt = y.dt AND x.ticker < y.ticker WINDOW w AS (PARTITION BY x.ticker, y.ticker ORDER BY x.dt))
SELECT series, count(*) AS n, round(avg(d), 7) AS mean_gap, round(stddev_samp(d), 7) AS sd_gap, round(max(abs(d)), 7) AS max_gap, round(stddev_samp(r), 7) AS sd_return_gap FROM j GROUP BY series""",
    "walk_forward_folds": f"""WITH {RETURNS_SQL}, f AS (SELECT CAST(fold AS INTEGER) AS fold, ticker, g, year(dt) - 1995 - fold AS y FROM returns, (SELECT unnest(range(0, {FOLDS})) AS fold))
SELECT fold, ticker, CASE WHEN y < 3 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(g), 5) AS mean, round(stddev_samp(g), 5) AS sd FROM f WHERE y >= 0 AND y < 4 GROUP BY 1, 2, 3""",
}
