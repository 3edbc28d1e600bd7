"""Spark-first analytics for panels of time series: returns, statistics, regime models, paths and backtests."""
