"""Selections, windows as rows, and series that others are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by() -> Window:
    return Window.partitionBy("ticker").orderBy("idx")


def vector_growth(held: DataFrame, prices: str = "prices", dt: float = 1 / 252) -> DataFrame:
    """(ticker, idx, g) of arrays of prices, idx from 1."""
    g = F.expr(f"transform(slice({prices}, 2, greatest(size({prices}) - 1, 0)), (p, i) -> {1 / dt!r}D * ln(p / {prices}[i]))")
    return held.select("ticker", F.posexplode(g).alias("at", "g")).select("ticker", (F.col("at") + 1).cast("long").alias("idx"), "g")


def in_every_part(bars: DataFrame, part: str = "part", parts: int = 2) -> DataFrame:
    """Rows of the tickers that have rows in all parts."""
    full = bars.groupBy("ticker").agg(F.count_distinct(part).alias("k")).where(F.col("k") == parts).select("ticker")
    return bars.join(full, "ticker", "left_semi")


def standardised(rows: DataFrame, is_train: str, x: str = "g") -> DataFrame:
    """z: x by the mean and sd of each ticker's training rows; 0 where the sd is null, 0 or not finite."""
    m = rows.where(is_train).groupBy("ticker").agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    good = (F.col("s") > 0) & (F.col("s") < float("inf"))
    return rows.join(m, "ticker", "left").withColumn("z", F.when(good, (F.col(x) - F.col("m")) / F.col("s")).otherwise(0.0)).drop("m", "s")


def windowize(returns: DataFrame, size: int, stride: int = 1, x: str = "g") -> DataFrame:
    """(ticker, window, pos, x): whole windows of `size` values, every `stride`, both numbered from 1. Each row goes to the windows it is in."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size) / stride))
    last = F.least(F.floor((F.col("idx") - 1) / stride), F.floor((n - size) / stride))
    rows = returns.withColumn("first", first).withColumn("last", last).where("first <= last")
    return rows.select("ticker", F.explode(F.sequence("first", "last")).alias("w"), "idx", x).select("ticker", (F.col("w") + 1).alias("window"), (F.col("idx") - F.col("w") * stride).alias("pos"), x)


def window_targets(returns: DataFrame, size: int, x: str = "g") -> DataFrame:
    """(ticker, idx, past, y): every array of `size` consecutive values and the value that follows."""
    past = F.collect_list(x).over(_by().rowsBetween(-size, -1))
    return returns.select("ticker", "idx", past.alias("past"), F.col(x).alias("y")).where(F.size("past") == size)


def differences(returns: DataFrame, x: str = "g") -> DataFrame:
    """First differences of x and of |x|."""
    before = F.lag(x).over(_by())
    return returns.select("ticker", "idx", (F.col(x) - before).alias("d"), (F.abs(x) - F.abs(before)).alias("d_abs")).where("d is not null")


def with_fallback(wanted: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of `first` for every wanted ticker that it has, those of `second` for the others; source tells which."""
    held = first.join(wanted, "ticker", "left_semi").withColumn("source", F.lit("first"))
    missing = wanted.join(first.select("ticker").distinct(), "ticker", "left_anti")
    return held.unionByName(second.join(missing, "ticker", "left_semi").withColumn("source", F.lit("second")))


def by_priority(key: list[str], *archives: DataFrame) -> DataFrame:
    """One row a key: that of the last archive that has it."""
    merged = None
    for i, a in enumerate(archives):
        a = a.select(*key, F.struct(F.lit(i).alias("priority"), F.struct(*[c for c in a.columns if c not in key]).alias("row")).alias("kept"))
        merged = a if merged is None else merged.unionByName(a)
    return merged.groupBy(*key).agg(F.max_by("kept.row", "kept.priority").alias("row")).select(*key, "row.*")


def rank_reordered(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(ticker, idx, g): each ticker's values in the rank order of another series u at idx."""
    v = values.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy("g", "idx"))).select("ticker", "r", "g")
    u = ranks.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy("u", "idx"))).select("ticker", "r", "idx")
    return u.join(v, ["ticker", "r"]).select("ticker", "idx", "g")
