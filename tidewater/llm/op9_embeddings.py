"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= t of unit vectors is a distance of at most eps = sqrt(2 - 2 t), and projecting on orthonormal directions only
shortens distances. Vectors get the cells of width eps that their leading principal dimensions fall in; sorted by label and
cells they are range-partitioned and cut into blocks, of at most `BLOCK_BYTES`, with a bounding box. Blocks of one label
meet where their intervals of the first cell are the same or neighbours and their boxes are within eps. Such a pair's two
sequences are halved recursively, intervals with boxes further apart are skipped, and what is left is compared by matrix
products in double precision. A pair of blocks gives each vector's number of links and a spanning star of what it has
linked, never the links themselves; a label of any size is as many blocks, so as many tasks, as it takes.

Equal vectors of a label are one class with a number of copies. The directions are fitted on at most `SAMPLE` vectors
(whose keys hash lowest); they only steer what is skipped. Vectors that are null, empty or zero, or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different lengths neither. A cosine of exactly t links.
Rows with the same vec_id stand each for itself; a component's id is its smallest vec_id that is not null. Other columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import n_partitions, scratch, written
from tidewater.llm.components import components, roots

LEAST, DIMENSIONS, TILE, SAMPLE = 0.93, 4, 128, 2000
BLOCK_BYTES = 4 << 20
_HELD = 1 << 20
_SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def directions(classes: DataFrame, dims: int = DIMENSIONS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length its leading principal directions."""
    got = classes.orderBy("class").limit(sample).select("dim", "embedding").collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.dim, []).append(r.embedding)
    out = {}
    for dim, rows in by.items():
        x = unit(np.array(rows, np.float64))
        out[dim] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:dims].T
    return out


def _join(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool, least: float, eps: float):
    """Tiles of index pairs (i of a, j of b) with a cosine of at least `least`; p, q: projections in grid order. same: a is b, then i < j."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if same and m <= i:
            continue
        gap = np.maximum(0, np.maximum(p[i:k].min(0) - q[j:m].max(0), q[j:m].min(0) - p[i:k].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if max(k - i, m - j) <= TILE:
            x, y = np.nonzero(a[i:k] @ b[j:m].T >= least)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif k - i >= m - j:
            h = (i + k) // 2
            todo += [(i, h, j, m), (h, k, j, m)]
        else:
            h = (j + m) // 2
            todo += [(i, k, j, h), (i, k, h, m)]


def _linked(a, b, p, q, copies_a, copies_b, same: bool, least: float, eps: float):
    """By row of a, then of b: its links, counted with copies, and spanning edges (of numbers of both); links are held a million at a time."""
    size = len(a)
    counts, edges, held, many = np.zeros(size + len(b), np.int64), np.zeros((2, 0), np.int64), [], 0

    def contracted():
        node, root = roots(*np.concatenate([edges, *held], axis=1))
        return np.stack([node[node != root], root[node != root]])

    for i, j in _join(a, b, p, q, same, least, eps):
        counts += np.bincount(i, weights=copies_b[j], minlength=len(counts)).astype(np.int64)
        counts += np.bincount(size + j, weights=copies_a[i], minlength=len(counts)).astype(np.int64)
        held.append(np.stack([i, j if same else size + j]))
        many += len(i)
        if many > _HELD:
            edges, held, many = contracted(), [], 0
    return counts, contracted()


def links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b, n: links of class a counted with copies (b null), and edges (a, b) that span what is linked (n null)."""
    spark, eps = classes.sparkSession, float(np.sqrt(2 - 2 * least)) + _SLACK
    axes = directions(classes)
    cells = [f"c{i}" for i in range(DIMENSIONS)]

    def project(batches):
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                axis = axes.get(dim, np.eye(dim)[:, :DIMENSIONS])
                p = _matrix(part.column("embedding"), dim) @ axis
                c = np.zeros((len(p), DIMENSIONS), np.int32)
                c[:, : p.shape[1]] = np.floor(p / eps)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in c.T.copy())], names=[*part.schema.names, *cells])

    def cut(batches):
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def close():
            nonlocal number
            ids, copies, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            p = rows @ axes.get(key[1], np.eye(key[1])[:, :DIMENSIONS])
            number += 1
            return pa.RecordBatch.from_pylist([{"block": number, "label": key[0], "dim": key[1], "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "ids": ids.tobytes(), "copies": copies.tobytes(), "rows": rows.tobytes()}], schema=kind)

        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            edges = np.flatnonzero(np.append(True, (np.diff(labels) != 0) | (np.diff(dims) != 0))).tolist() if len(labels) else []
            for a, b in zip(edges, [*edges[1:], len(labels)], strict=True):
                if held and key != (labels[a], dims[a]):
                    yield close()
                    held = []
                key = (int(labels[a]), int(dims[a]))
                most = max(TILE, BLOCK_BYTES // (8 * key[1]))
                while a < b:
                    room = min(b - a, most - sum(len(x[0]) for x in held))
                    part = batch.slice(a, room)
                    held.append((part.column("class").to_numpy(), part.column("copies").to_numpy(), _matrix(part.column("embedding"), key[1])))
                    a += room
                    if sum(len(x[0]) for x in held) == most:
                        yield close()
                        held = []
        if held:
            yield close()

    kind = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("rows", pa.binary())])
    ordered = classes.mapInArrow(project, "class long, label long, dim int, copies long, embedding array<double>, " + ", ".join(f"{c} int" for c in cells))
    size = classes.agg(F.sum(8.0 * F.col("dim"))).first()[0] or 0  # no more ranges than blocks: a range's end is a block's
    ranges = max(1, min(n_partitions(spark), int(size // BLOCK_BYTES)))
    ordered = ordered.repartitionByRange(ranges, "label", "dim", *cells, "class").sortWithinPartitions("label", "dim", *cells, "class")
    blocks = written(ordered.mapInArrow(cut, "block long, label long, dim int, lo array<double>, hi array<double>, ids binary, copies binary, rows binary"), "blocks")

    boxes = blocks.selectExpr("block", "label", "dim", "lo", "hi", f"cast(floor(lo[0] / {eps!r}) as int) as first", f"cast(floor(hi[0] / {eps!r}) as int) as last")
    other = boxes.selectExpr("block as block_b", "label", "dim", "lo as lo_b", "hi as hi_b", "explode(sequence(first - 1, last + 1)) as cell")
    gap = F.expr("aggregate(zip_with(zip_with(lo, hi_b, (x, y) -> x - y), zip_with(lo_b, hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, x) -> s + x * x)")
    near = boxes.withColumn("cell", F.expr("explode(sequence(first, last))")).join(other, ["label", "dim", "cell"])
    near = near.where((F.col("block") <= F.col("block_b")) & (gap <= eps * eps)).select("block", "block_b", "dim").distinct()
    side = blocks.select("block", "ids", "copies", "rows")
    second = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    cross = near.where("block <> block_b").join(side, "block").join(second, "block_b")
    met = cross.unionByName(near.where("block = block_b").join(side, "block"), allowMissingColumns=True)  # a block with itself goes once

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                axis = axes.get(dim, np.eye(dim)[:, :DIMENSIONS])
                (ia, ca, va), (ib, cb, vb) = ((np.frombuffer(r["ids" + s], np.int64), np.frombuffer(r["copies" + s], np.int64), np.frombuffer(r["rows" + s], np.float64).reshape(-1, dim)) for s in ("", "" if r["block"] == r["block_b"] else "_b"))
                same = r["block"] == r["block_b"]
                n, (node, root) = _linked(va, vb, va @ axis, vb @ axis, ca, cb, same, least, eps)
                ids = np.concatenate([ia, ib])
                if same:  # both halves are one block
                    n = np.concatenate([n[: len(ia)] + n[len(ia) :], np.zeros(len(ia), np.int64)])
                who, node, root = np.flatnonzero(n), ids[node], ids[root]
                counted = np.arange(len(who) + len(node)) < len(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(ids[who], node)), pa.array(np.append(np.zeros(len(who), np.int64), root), mask=counted), pa.array(np.append(n[who], np.zeros(len(node), np.int64)), mask=~counted)],
                    names=["a", "b", "n"],
                )

    return written(met.repartition(4 * n_partitions(spark)).mapInArrow(compare, "a long, b long, n long"), "links", lasting=True)


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept per row."""
    good = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("class", F.when(good, F.xxhash64("label", "embedding")))
    classes = rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first(F.size("embedding")).alias("dim"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"))
    with scratch(vectors.sparkSession):
        classes = written(classes, "classes")
        with scratch(vectors.sparkSession):
            found = links(classes.select("class", "label", "dim", "copies", "embedding"), least)
        labels = written(components(found.where("b is not null").select("a", "b")), "labels").withColumnsRenamed({"node": "class", "label": "root"})
        counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
        info = classes.select("class", "copies", "least").join(labels, "class", "left").withColumn("root", F.coalesce("root", "class")).join(counts, "class", "left")
        first = info.groupBy("root").agg(F.min("least").alias("component_id"))
        info = info.join(first, "root").select("class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        info = written(info, "info", lasting=True)
    got = rows.select("vec_id", "class").join(info, "class", "left")
    own = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
