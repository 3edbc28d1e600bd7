"""Sums and order statistics over all pairs of windows, by tiles.

Vectors are dealt to blocks of about TILE by their hash; a tile is a pair of blocks and is one task's group. A vector goes
once to each tile of its block, pairs are formed in the tile by array arithmetic and only sums or counts come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.simulate import hash_uniform

TILE = 256


def archive_windows(paths: DataFrame, size: int, n: int, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """(ticker, window, pos, g): n windows of `size` steps, each from a path and a start drawn by hash; none where paths are shorter."""
    draws = paths.sparkSession.range(1, n + 1).select(F.col("id").alias("window"))
    draws = draws.select("window", (F.floor(hash_uniform(F.col("window"), F.lit(1), seed) * n_paths) + 1).alias("path_id"), (F.floor(hash_uniform(F.col("window"), F.lit(2), seed) * (n_steps - size + 1)) + 1).alias("start"))
    if n_steps < size:
        draws = draws.limit(0)
    steps = draws.select("window", "path_id", "start", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long"))).alias("pos")).withColumn("t", F.col("start") + F.col("pos") - 1)
    return steps.join(paths, ["path_id", "t"]).select("ticker", "window", "pos", "g")


def vectors(windows: DataFrame, side: int, x: str = "g") -> DataFrame:
    """(ticker, side, id, v): the values of every window in order."""
    held = windows.groupBy("ticker", F.col("window").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(x).cast("double").alias("x")))), lambda s: s["x"]).alias("v"))
    return held.select("ticker", F.lit(side).alias("side"), "id", "v")


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    """A row of each vector for each tile (i, j), i <= j, of its block."""
    blocks = rows.groupBy("ticker").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    rows = rows.join(blocks, "ticker").withColumn("block", F.pmod(F.xxhash64("side", "id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _pairs(table: pa.Table):
    """Squared distances of the tile's pairs, a stretch of rows at a time, with the sides of both ends."""
    block = table["block"].to_numpy()
    v = np.array(table["v"].to_pylist(), np.float64).reshape(len(block), -1)
    side, i, j = table["side"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for lo in range(0, len(a), 32):
        rows = a[lo : lo + 32]
        d = ((v[rows][:, None, :] - v[b][None, :, :]) ** 2).sum(-1)
        keep = np.ones(d.shape, bool) if i != j else np.arange(lo, lo + len(rows))[:, None] < np.arange(len(b))[None, :]
        yield d[keep], np.broadcast_to(side[rows][:, None], d.shape)[keep] + np.broadcast_to(side[b][None, :], d.shape)[keep]


def median_distance(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(ticker, bandwidth): the median squared distance of all pairs of vectors, exact; 1 where it is 0 or there is no pair.

    The two middle order statistics are selected by the bits of their doubles, which order as the numbers do: four passes
    count the pairs by the next 16 bits behind those already known. Distances are worked out anew in each pass, none is kept.
    """
    n = rows.groupBy("ticker").agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))
    found = n.where("pairs > 0").select("ticker", F.posexplode(F.array(F.expr("(pairs - 1) div 2"), F.expr("pairs div 2"))).alias("target", "rank"), F.lit(0).cast("long").alias("known"))

    def counter(shift: int):
        def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            known, rank = table["known"][0].as_py(), table["rank"][0].as_py()
            held: list[dict[int, int]] = [{}, {}]
            for d, _ in _pairs(table):
                bits = d.view(np.uint64)
                for t in range(2):
                    mine = bits if shift == 48 else bits[bits >> np.uint64(shift + 16) == np.uint64(known[t])]
                    digits, times = np.unique(mine >> np.uint64(shift) & np.uint64(0xFFFF), return_counts=True)
                    for digit, k in zip(digits.tolist(), times.tolist(), strict=True):
                        held[t][digit] = held[t].get(digit, 0) + k
            told = [(key[0].as_py(), t, rank[t], known[t], digit, k) for t in range(2) for digit, k in held[t].items()]
            return pa.table({f.name: pa.array([r[i] for r in told], f.type) for i, f in enumerate(kind)})

        return count

    kind = pa.schema([("ticker", pa.string()), ("target", pa.int32()), *((c, pa.int64()) for c in ("rank", "known", "digit", "times"))])
    tiled = _tiled(rows, tile)
    for shift in (48, 32, 16, 0):
        given = found.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("target", "rank", "known"))).alias("g")).selectExpr("ticker", "g.rank", "g.known")
        counts = tiled.join(given, "ticker").groupBy("ticker", "i", "j").applyInArrow(counter(shift), "ticker string, target int, rank long, known long, digit long, times long")
        counts = counts.groupBy("ticker", "target", "rank", "known", "digit").agg(F.sum("times").alias("times"))
        before = F.sum("times").over(Window.partitionBy("ticker", "target").orderBy("digit")) - F.col("times")
        counts = counts.withColumn("before", before).where("rank >= before and rank < before + times")
        found = counts.select("ticker", "target", (F.col("rank") - F.col("before")).alias("rank"), F.shiftleft("known", 16).bitwiseOR(F.col("digit")).alias("known"))

    def doubles(batches):
        for batch in batches:
            value = np.ascontiguousarray(batch.column("known").to_numpy()).view(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("ticker"), pa.array(value)], names=["ticker", "value"])

    middle = found.select("ticker", "known").mapInArrow(doubles, "ticker string, value double").groupBy("ticker").agg(F.avg("value").alias("value"))
    return n.join(middle, "ticker", "left").select("ticker", F.when(F.col("value") > 0, F.col("value")).otherwise(1.0).alias("bandwidth"))


def mmd2(rows: DataFrame, bandwidth: DataFrame, tile: int = TILE) -> DataFrame:
    """(ticker, n, m, mmd2): unbiased squared maximum mean discrepancy of sides 0 and 1 with exp(-d^2 / bandwidth), 0 at least.

    Where a side has fewer than two vectors it is the biased one; null without vectors on a side.
    """

    def sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total, scale = np.zeros(3), table["bandwidth"][0].as_py()
        for d, kind in _pairs(table):
            total += np.bincount(kind, np.exp(-d / scale), 3)
        return pa.table({"ticker": pa.array([key[0].as_py()], pa.string()), "s0": [total[0]], "s01": [total[1]], "s1": [total[2]]})

    sizes = rows.groupBy("ticker").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    tiles = _tiled(rows, tile).join(bandwidth, "ticker").groupBy("ticker", "i", "j").applyInArrow(sums, "ticker string, s0 double, s01 double, s1 double")
    got = sizes.join(tiles.groupBy("ticker").agg(*(F.sum(c).alias(c) for c in ("s0", "s01", "s1"))), "ticker")
    n, m = F.nullif("n", F.lit(0)).cast("double"), F.nullif("m", F.lit(0)).cast("double")
    free = (F.col("n") > 1) & (F.col("m") > 1)
    own = lambda s, k: F.when(free, 2 * F.col(s) / F.nullif(k * (k - 1), F.lit(0.0))).otherwise((2 * F.col(s) + k) / (k * k))
    value = own("s0", n) + own("s1", m) - 2 * F.col("s01") / (n * m)
    return got.select("ticker", "n", "m", F.when(value.isNotNull(), F.greatest(F.lit(0.0), value)).alias("mmd2"))
