import os

import pytest
from pyspark.sql import functions as F

from tidewater.sources.bars import event_bars
from tidewater.streaming.bars import event_stream, hourly_bars

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    query = hourly_bars(event_stream(spark, folder, 10)).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {(r.ticker, r.ts, r.n) for r in spark.table("hourly").collect()}
    want = {(r.ticker, r.ts, r.n) for r in event_bars(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).collect()}
    assert got == want


def test_watermark_closes_hours(spark, tmp_path):
    """Append mode gives an hour's bar once, after a later event has moved the watermark past it, and drops what comes too late."""
    folder, rows = tmp_path / "events", []
    for i, (ts, value) in enumerate([("2024-01-01 10:10:00", 1.0), ("2024-01-01 10:50:00", 3.0), ("2024-01-01 13:30:00", 5.0), ("2024-01-01 10:20:00", 100.0), ("2024-01-01 18:00:00", 7.0)]):
        rows.append((i, ts, "a", value))
        df = spark.createDataFrame([rows[-1]], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        query = hourly_bars(event_stream(spark, str(folder), 1)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(str(r.ts), r.vwap, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01 10:00:00", 2.0, 2), ("2024-01-01 13:00:00", 5.0, 1)}
