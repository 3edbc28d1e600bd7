"""Places of rows in the order of their group, for groups of any size: sorted over range partitions, then counted by runs.

A run is what one range partition holds of one group. No task sees more of a group than its own partition, so that a group
with a third of all rows is as cheap as many small ones; a group has as many runs as partitions at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import n_partitions, written

_RUN = 33  # monotonically_increasing_id has the partition above this bit


def laid_out(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df as a table, with `at`, which ascends by group and order, and `run`, its range partition. Equal rows are dealt out too."""
    keys = [*(F.col(c).asc_nulls_first() for c in group), *order, F.col("at")]
    df = df.withColumn("at", F.monotonically_increasing_id())
    df = df.repartitionByRange(n_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    return written(df.withColumn("run", F.shiftright("at", _RUN)), name)


def runs(laid: DataFrame, group: list[str]) -> DataFrame:
    """A row for each run: its first `at`, how many rows of the group come `before` it, and the group's `total`."""
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counted = laid.groupBy(*group, "run").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    return counted.select(*group, "run", "first_at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))


def numbered(laid: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """laid with each row's `place` in its group, from 0, and what else `found`, rows of runs(), has."""
    got = laid.join(found, [*group, "run"]).withColumn("place", F.col("at") - F.col("first_at") + F.col("before"))
    return got.drop("at", "run", "first_at", "before")


def sums_before(df: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with `sum_before`: the sum of value over the rows of its group that come before it."""
    laid = laid_out(df, group, [F.col(order)], name)
    earlier = Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    held = laid.groupBy(*group, "run").agg(F.sum(value).alias("held"))
    held = held.select(*group, "run", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("carried"))
    inner = Window.partitionBy(*group, "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    got = laid.withColumn("inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(held, [*group, "run"])
    return got.withColumn("sum_before", F.col("inner") + F.col("carried")).drop("at", "run", "inner", "carried")
