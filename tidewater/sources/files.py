"""Typed scans and partitioned sinks of the panel's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DAILY = "PERMNO int, Ticker string, DlyCalDt date, DlyPrc double, DlyFacPrc double"


def daily_prices(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, dt, close) of a vendor's daily CSV: price over its adjustment factor, one row per ticker and date (lowest number)."""
    rows = spark.read.schema(DAILY).option("header", True).csv(path)
    first = rows.groupBy(F.col("Ticker").alias("ticker"), F.col("DlyCalDt").alias("dt")).agg(F.min_by(F.struct("DlyPrc", "DlyFacPrc"), "PERMNO").alias("r"))
    return first.select("ticker", "dt", F.try_divide(F.col("r.DlyPrc"), F.col("r.DlyFacPrc")).alias("close"))


def index_levels(spark: SparkSession, path: str) -> DataFrame:
    """(dt, close, log_close) of an index CSV with dates as MM/dd/yyyy; rows without a close are left out."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])
    out = rows.select(F.to_date("date", "MM/dd/yyyy").alias("dt"), F.expr("try_cast(close as double)").alias("close")).where("close > 0")
    return out.withColumn("log_close", F.log("close"))


def stitched(a: DataFrame, b: DataFrame, since: str) -> DataFrame:
    """Rows of a before the date, of b from it on."""
    return a.where(F.col("dt") < F.lit(since).cast("date")).unionByName(b.where(F.col("dt") >= F.lit(since).cast("date")))


def write_paths(paths: DataFrame, folder: str, *by: str) -> None:
    """Simulated paths as Parquet, partitioned by model and window so that a score reads only its own."""
    paths.write.mode("overwrite").partitionBy(*by).parquet(folder)


def write_report(rows: DataFrame, folder: str, digits: int = 4) -> None:
    """A report's rows as CSV with a header: doubles rounded half to even, which is how reports round."""
    told = [F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*told).write.mode("overwrite").option("header", True).csv(folder)


def read_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A report's CSV by its schema; columns are found by name, so that their order doesn't matter."""
    held = spark.read.option("header", True).csv(folder)
    kinds = StructType.fromDDL(schema)
    return held.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds])


def write_text_table(rows: DataFrame, folder: str, widths: dict[str, int], digits: int = 4) -> None:
    """Fixed-width lines under a line of names, in the order of the first column; a partition at a time, none gathered."""
    first = next(iter(widths))
    cell = {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", c)) if t == "double" else F.col(c).cast("string") for c, t in rows.dtypes}
    line = F.concat_ws(" ", *[F.lpad(F.coalesce(cell[c], F.lit("-")), w, " ") for c, w in widths.items()])
    head = rows.sparkSession.createDataFrame([(0, None, " ".join(c.rjust(w)[:w] for c, w in widths.items()))], f"part int, key {dict(rows.dtypes)[first]}, value string")
    body = rows.select(F.lit(1).alias("part"), F.col(first).alias("key"), line.alias("value"))
    head.unionByName(body).sort("part", "key", "value").select("value").write.mode("overwrite").text(folder)
