"""Best-fit packing of token sequences with certified bounds.

Documents are encoded and, where longer than a sequence, cut. Whole-sequence pieces need no packing. The others are dealt
by hash into partitions of a bounded number of pieces; each is packed by best-fit decreasing, and dual feasible functions
give a lower bound on its bins. A partition that meets its bound is certified and keeps its bins but the emptiest. The others
exchange: the pieces of their unfilled bins are dealt by bin into fewer pools and packed again, round by round, until one
pool is left or what they hold doesn't fit half as many pools of `pool_pieces`; then the bins stay as they are. So a task
holds a bounded number of pieces at any size of corpus. Only lengths move; the ids are never shuffled.

Null texts are empty (one end id). Rows with the same doc_id are packed each for itself; other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, text_bytes, written
from tidewater.llm.encoding import run_encoder

SEQUENCE = 1024
#: Pieces of a partition, partitions that pool what they release, and pieces of a pool.
PART_PIECES, POOL, POOL_PIECES = 65_536, 16, 1 << 20
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % most or most
    return [(0, min(n, first)), *((a, most) for a in range(first, n, most))]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, most: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def encode(batches):
        encoder = run_encoder(vocabulary)
        for batch in batches:
            for part in chunks(batch):
                ids, at = encoder.ids(*text_bytes(part.column("text")))
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                ends = at[1:] + np.arange(1, len(at))
                out = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out += [(doc, k, s, n, zlib.crc32(ids[a + s : a + s + n])) for k, (s, n) in enumerate(cut(b - a, most))]
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _PIECE)


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length under best-fit decreasing, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(most + 1)]  # open bins by room left
    rooms, n = 0, 0  # rooms: bit r is set if a bin with room r is open
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b, n = most, n, n + 1
        bins[i], offsets[i] = b, most - room
        left = room - size
        if left:
            free[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """The largest bound on the number of bins that these dual feasible functions give: identity, thresholds, rounding by k."""
    count = np.bincount(lengths, minlength=most + 1).astype(np.int64)
    size = np.arange(most + 1)
    best = -(-int((count * size).sum()) // most)
    upto, weight = np.cumsum(count), np.cumsum(count * size)
    for k in range(1, most // 2 + 1):  # above most - k: 1; below k: 0; between: the size
        large = int(upto[most] - upto[most - k])
        best = max(best, large + -(-int(weight[most - k] - weight[k - 1]) // most))
    for k in range(1, 101):  # floor((k + 1) x) / k, and x where (k + 1) x is whole
        scaled = (k + 1) * size
        value = np.where(scaled % most == 0, size * k, scaled // most * most)
        best = max(best, -(-int((count * value).sum()) // (k * most)))
    return best


def _pack_round(df: DataFrame, level: int, most: int) -> DataFrame:
    """Packs each `part`. sequence_id and offset of each piece; gap: the part's bins over its bound; free: 1 if the bin is given up to the next round."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, n = best_fit(lengths, most)
        before = table.column("sequence_id").to_numpy(zero_copy_only=False)
        if level and len(np.unique(before)) <= n:  # the bins that were released were as good
            bins, offsets = before, table.column("offset").to_numpy()
        else:
            bins += (level << 58) + (int(table.column("part")[0].as_py()) << 24)
        _, number = np.unique(bins, return_inverse=True)
        filled = np.bincount(number, weights=lengths).astype(np.int64)[number]
        gap = number.max() + 1 - lower_bound(lengths, most)
        free = (filled < most) & ((gap > 0) | (filled == filled.min()))
        for name, values in (("sequence_id", bins), ("offset", offsets), ("gap", np.full(len(bins), gap)), ("free", free.astype(np.int64))):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return table

    return df.groupBy("part").applyInArrow(run, f"{_PIECE}, part long, sequence_id long, offset long, gap long, free long")


def pack(piece_rows: DataFrame, most: int = SEQUENCE, part_pieces: int = PART_PIECES, pool_pieces: int = POOL_PIECES) -> DataFrame:
    """piece_rows with sequence_id and offset. piece_rows must be a table (it is read more than once)."""
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = piece_rows.where(F.col("length") == most).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = piece_rows.where(F.col("length") < most)
    parts = max(1, -(-short.count() // part_pieces))
    none = F.lit(0).cast("long")
    dealt = short.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    open_ = written(_pack_round(dealt.select("*", none.alias("sequence_id"), none.alias("offset"), none.alias("gap"), none.alias("free")), 0, most), "packed-0")
    done, level = [full.select(kept)], 0
    while parts > 1:
        pools = max(-(-parts // POOL), -(-open_.where("free = 1").count() // pool_pieces))
        if 2 * pools > parts + 1:
            break
        done.append(open_.where("free = 0").select(kept))
        parts, level = pools, level + 1
        pooled = open_.where("free = 1").withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)))
        open_ = written(_pack_round(pooled, level, most), f"packed-{level}")
    out = open_.select(kept)
    for df in done:
        out = out.unionByName(df)
    return out


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(written(pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
