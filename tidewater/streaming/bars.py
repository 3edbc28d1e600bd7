"""Bars and returns of an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream, with an event-time timestamp."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_bars(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(ticker, ts, vwap, n) of each hour and event type, closed once the watermark has passed it."""
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("ticker")).agg(F.avg("value").alias("vwap"), F.count("*").alias("n"))
    return bars.select("ticker", F.col("window.start").alias("ts"), "vwap", "n")


def rolling_growth(bars: DataFrame, alpha: float = 0.06) -> DataFrame:
    """(ticker, ts, g, s2): log growth from bar to bar with an exponentially weighted variance, kept per ticker between batches.

    Bars of one micro-batch are taken in order of time; a price that is not positive gives no row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, s2 = state.get if state.exists else (float("nan"), 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        import math

        out = []
        for ts, price in zip(rows["ts"], rows["vwap"], strict=True):
            if price is None or not price > 0:
                continue
            if last == last:
                g = math.log(price / last)
                s2 = (1 - alpha) * s2 + alpha * g * g
                out.append((key[0], ts, g, s2))
            last = price
        state.update((last, s2))
        yield pd.DataFrame(out, columns=["ticker", "ts", "g", "s2"])

    return bars.groupBy("ticker").applyInPandasWithState(step, "ticker string, ts timestamp, g double, s2 double", "last double, s2 double", "append", GroupStateTimeout.NoTimeout)
