"""Logarithms of sums of exponentials from pairs (maximum, scaled sum) that merge in any tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.special import log_of, log_pair, merged_logs
from tidewater.operators.timeseries import _by

SIZE = 128
_NONE = "named_struct('m', double('-Infinity'), 's', 0D)"


def _merged(items: str, pair: str) -> str:
    return f"aggregate({items}, {_NONE}, (a, e) -> {merged_logs('a', pair)})"


def log_sum_exp(rows: DataFrame, x: str = "g", size: int = SIZE) -> DataFrame:
    """(ticker, n, lse): ln of the sum of exp(x), by segments of `size` steps and blocks of segments; -Infinity counts as nothing."""
    parts = rows.groupBy("ticker", F.expr(f"(idx - 1) div {size}").alias("seg")).agg(F.collect_list(F.col(x).cast("double")).alias("v"))
    parts = parts.selectExpr("ticker", "seg", "size(v) as n", f"transform(v, y -> {log_pair('y')}) as v").selectExpr("ticker", f"seg div {size} as block", "n", f"{_merged('v', 'e')} as p")
    blocks = parts.groupBy("ticker", "block").agg(F.sum("n").alias("n"), F.collect_list("p").alias("v")).selectExpr("ticker", "n", f"{_merged('v', 'e')} as p")
    return blocks.groupBy("ticker").agg(F.sum("n").alias("n"), F.collect_list("p").alias("v")).selectExpr("ticker", "n", f"{_merged('v', 'e')} as p").selectExpr("ticker", "n", f"{log_of('p')} as lse")


def rolling_log_sum_exp(rows: DataFrame, w: int, x: str = "g") -> DataFrame:
    """(ticker, idx, lse) of the last w steps, from the w-th on."""
    held = rows.select("ticker", "idx", F.collect_list(F.col(x).cast("double")).over(_by().rowsBetween(1 - w, 0)).alias("v")).where(F.col("idx") >= w)
    return held.selectExpr("ticker", "idx", f"transform(v, y -> {log_pair('y')}) as v").selectExpr("ticker", "idx", f"{_merged('v', 'e')} as p").selectExpr("ticker", "idx", f"{log_of('p')} as lse")
