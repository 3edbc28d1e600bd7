"""Queries that fit, decode and simulate models; their rows depend on optimisers and draws, so tests hold their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import dependence, regimes, risk, simulate, volatility
from tidewater.plans.panel import returns


def _scaled(spark, sf_dir):
    return returns(spark, sf_dir).withColumn("g", F.col("g") / 100)


def hmm_fits(spark, sf_dir):
    """Every family with 2 and 3 states for every ticker."""
    return regimes.fit_regimes(_scaled(spark, sf_dir), ["normal", "t", "laplace", "ged"], [2, 3])


def _two_states(spark, sf_dir):
    return regimes.fit_regimes(_scaled(spark, sf_dir), ["normal", "t"], [2])


def viterbi_states(spark, sf_dir):
    return regimes.decode(_scaled(spark, sf_dir), _two_states(spark, sf_dir))


def regime_paths(spark, sf_dir):
    return simulate.regime_paths(_two_states(spark, sf_dir), 20, 250)


def conditional_var(spark, sf_dir):
    """Coverage tests of the regime-conditional 5 % VaR."""
    out = regimes.conditional_var(_scaled(spark, sf_dir), regimes.fit_regimes(_scaled(spark, sf_dir), ["normal", "laplace"], [2]), 0.05)
    return risk.coverage_tests(out, 0.05, "ticker", "family", "k")


def volatility_fits(spark, sf_dir):
    return volatility.fit_volatility(_scaled(spark, sf_dir), ["garch", "gjr", "egarch", "garch_t"])


def garch_paths(spark, sf_dir):
    fits = volatility.fit_volatility(_scaled(spark, sf_dir), ["garch"]).select("ticker", *[F.col("params")[c].alias(c) for c in ("omega", "alpha", "beta")])
    return simulate.garch_paths(fits, 20, 250)


def block_bootstrap_paths(spark, sf_dir):
    return simulate.block_bootstrap(_scaled(spark, sf_dir), 20, 10.0)


def copula_profile(spark, sf_dir):
    """Log-likelihood by degrees of freedom for the three series, with the Gaussian copula as 1e9."""
    return dependence.copula_profile(_scaled(spark, sf_dir), ["A", "N", "R"], [3, 5, 8, 15, 30, 1e9])


QUERIES = {f.__name__: f for f in (hmm_fits, viterbi_states, regime_paths, conditional_var, volatility_fits, garch_paths, block_bootstrap_paths, copula_profile)}
ORACLES: dict[str, str] = {}
