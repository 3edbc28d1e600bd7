"""A run of named stages and the table of how each went."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[SparkSession], DataFrame], str]]) -> DataFrame:
    """Each stage's rows written to its folder; (stage, status, seconds, rows, message) of all. One that fails doesn't stop the next."""
    told = []
    for name, make, folder in stages:
        began = time.perf_counter()
        try:
            make(spark).write.mode("overwrite").parquet(folder)
            told.append((name, "done", time.perf_counter() - began, spark.read.parquet(folder).count(), None))
        except Exception as e:  # whatever it is, it goes into the table
            told.append((name, "failed", time.perf_counter() - began, None, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(told, "stage string, status string, seconds double, rows long, message string")
