"""Truncated signatures of paths (time, value) as products in the tensor algebra: associative, so segments combine in any tree."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 128


def words(depth: int) -> list[tuple[int, ...]]:
    """Index tuples of all components by level, the first index fastest: 0 is time, 1 the value."""
    return [w[::-1] for level in range(1, depth + 1) for w in product((0, 1), repeat=level)]


def _times(a: str, b: str, depth: int, step: bool = False) -> str:
    """Array of the product of two truncated elements, whose level 0 is 1; step: b has only level 1."""
    all_ = words(depth)
    at = {w: i for i, w in enumerate(all_)}

    def component(w):
        parts = [f"{a}[{at[w]}]"] if w else []
        for cut in range(len(w)):
            left, right = w[:cut], w[cut:]
            if step and len(right) > 1:
                continue
            other = f"{b}[{at[right]}]"
            parts.append(f"{a}[{at[left]}] * {other}" if left else other)
        return " + ".join(parts)

    return f"array({', '.join(map(component, all_))})"


def signatures(windows: DataFrame, depth: int = 3, size: int = SIZE) -> DataFrame:
    """(ticker, window, n, s): iterated sums of the increments of (t, x), t evenly from 0 to 1, x by its sample deviation.

    windows: ticker, window, pos from 1, g. A path of fewer than two points has zeros. Increments are scaled at the end: a
    component is homogeneous in either coordinate. Segments of `size` increments are multiplied in parallel, then their products.
    """
    key = ["ticker", "window"]
    before = F.lag("g").over(Window.partitionBy(*key).orderBy("pos"))
    steps = windows.withColumn("d", F.col("g") - before).where("d is not null").select(*key, F.expr(f"(pos - 2) div {size}").alias("seg"), "pos", F.array(F.lit(1.0), "d").alias("m"))
    none = f"array({', '.join(['0D'] * len(words(depth)))})"

    def folded(rows: DataFrame, *by: str, order: str, step: bool) -> DataFrame:
        held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "m"))).alias("v"))
        return held.select(*by, F.expr(f"aggregate(v, {none}, (a, e) -> {_times('a', 'e.m', depth, step)})").alias("m"))

    parts = folded(steps, *key, "seg", order="pos", step=True)
    parts = folded(parts.withColumn("block", F.expr(f"seg div {size}")), *key, "block", order="seg", step=False)
    whole = folded(parts, *key, order="block", step=False)
    sizes = windows.groupBy(*key).agg(F.count("*").alias("n"), F.greatest(F.stddev_samp("g"), F.lit(1e-12)).alias("sd"))
    scale = [" * ".join(["1D", *(["1D / (n - 1)", "1D / sd"][i] for i in w)]) for w in words(depth)]
    scaled = "array({})".format(", ".join(f"m[{i}] * {s}" for i, s in enumerate(scale)))
    return sizes.join(whole, key, "left").select(*key, "n", F.expr(f"if(m is null, {none}, {scaled})").alias("s"))


def vectors(windows: DataFrame, side: int, depth: int = 3) -> DataFrame:
    """(ticker, side, id, v): the signature of every window, for scores by tiles."""
    rows = signatures(windows, depth)
    return rows.select("ticker", F.lit(side).alias("side"), F.col("window").cast("long").alias("id"), F.col("s").alias("v"))
