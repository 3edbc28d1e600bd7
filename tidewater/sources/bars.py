"""Price bars built from transaction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lineitem_bars(spark: SparkSession, sf_dir: str, ticker: str = "l_returnflag") -> DataFrame:
    """Daily volume-weighted bars of lineitem: (ticker, dt, vwap, volume, n), one row per ticker and day."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.expr(ticker).alias("ticker"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.sum("l_quantity").alias("volume"), F.count("*").alias("n")
    )


def ohlc_bars(spark: SparkSession, sf_dir: str, ticker: str = "l_returnflag") -> DataFrame:
    """Daily open, high, low, close of unit prices and volume; first and last are by a full order of the rows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rows.groupBy(F.expr(ticker).alias("ticker"), F.col("l_shipdate").cast("date").alias("dt")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value of events by type: (ticker, ts, vwap, n)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("vwap"), F.count("*").alias("n"))
