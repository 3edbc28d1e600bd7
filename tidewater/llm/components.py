"""Connected components by alternating large-star and small-star steps, each a join and a grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges, and the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        lo, hi = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        np.minimum.at(up, hi, lo)
        while (up[up] != up).any():
            up = up[up]
        keep = up[x] != up[y]
        x, y = x[keep], y[keep]
    return nodes, nodes[up]


def _contracted(edges: DataFrame) -> DataFrame:
    """A spanning star of what each partition's edges connect: as many rows as nodes at most."""

    def run(batches):
        held, size = [], 0

        def close():
            ab = np.concatenate(held, axis=1)
            node, root = roots(ab[0], ab[1])
            away = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(root[away])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
            size += batch.num_rows
            if size > 2_000_000:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b long): label is the smallest node reachable. Loops and repeats don't matter."""
    now = written(_contracted(edges.where("a <> b").select("a", "b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20)")).alias("s")).first()
        if (got["n"], got["s"]) == mark:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = (got["n"], got["s"])
