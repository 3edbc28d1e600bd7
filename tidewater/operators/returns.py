"""Annualised log growth of price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_growth(bars: DataFrame, price: str = "vwap", dt: float = 1 / 252, rf: float = 0.0, order: str = "dt") -> DataFrame:
    """(1/dt)*ln(p_t/p_{t-1}) - rf per ticker, without the first row; idx counts from 1."""
    w = Window.partitionBy("ticker").orderBy(order)
    lagged = bars.withColumn("prev", F.lag(price).over(w)).where("prev is not null")
    g = F.lit(1 / dt) * F.log(F.col(price) / F.col("prev")) - F.lit(rf)
    return lagged.select("ticker", order, F.row_number().over(w).cast("long").alias("idx"), g.alias("g"))


def cumulative_vwap(bars: DataFrame) -> DataFrame:
    """Running volume-weighted mean of the typical price (high + low + close) / 3."""
    w = Window.partitionBy("ticker").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.select("ticker", "dt", (F.sum(typical * F.col("volume")).over(w) / F.sum("volume").over(w)).alias("cum_vwap"))


def complete_universe(bars: DataFrame, reference: str) -> DataFrame:
    """Rows of tickers that have as many bars as the reference ticker."""
    n = bars.groupBy("ticker").agg(F.count("*").alias("bars"))
    wanted = n.where(F.col("ticker") == reference).select(F.col("bars").alias("wanted"))
    full = n.join(F.broadcast(wanted), F.col("bars") == F.col("wanted")).select("ticker")
    return bars.join(full, "ticker", "left_semi")


def split_at_anniversary(bars: DataFrame, reference: str, years: int = 10) -> DataFrame:
    """bars with part: IS up to `years` years after the reference ticker's first day, OOS after."""
    cut = bars.where(F.col("ticker") == reference).agg(F.add_months(F.min("dt"), 12 * years).alias("cut"))
    return bars.join(F.broadcast(cut)).withColumn("part", F.when(F.col("dt") <= F.col("cut"), "IS").otherwise("OOS")).drop("cut")
