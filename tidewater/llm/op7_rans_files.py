"""Token-id files: static range asymmetric numeral system over interleaved, independently decodable blocks.

`token_segments` sorts documents by id over range partitions and packs each run of whole documents into a segment: one
frequency table, shared by the segment's blocks; for each block a checkpoint (where its words begin and its lanes'
states) and a CRC-32 of its ids. A block is coded in `LANES` interleaved lanes, so all lanes of all blocks of a segment
advance together, and any block can be decoded alone. A writer holds one segment and a reader one segment at a time.

Null texts are empty. Rows with the same doc_id follow each other by text; null ids come first. Other columns are ignored.
An empty table gives an empty file set and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, n_partitions, text_bytes, written
from tidewater.llm.encoding import run_encoder

MAGIC = b"TWR1"
LANES, BLOCK, SCALE = 64, 1 << 16, 20
SEGMENT = 1 << 22
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIII")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, and their frequencies scaled to a sum of 2**SCALE, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    freq = np.maximum(1, counts * total // counts.sum())
    over = int(freq.sum()) - total
    while over:  # what rounding leaves goes to, or comes from, the largest
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
            break
        for i in order:
            take = min(over, int(freq[i]) // 2)
            freq[i] -= take
            over -= take
            if not over or freq[i] < 2:
                break
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def _encode(grid: np.ndarray, freq: np.ndarray, cum: np.ndarray):
    """grid: symbol numbers (blocks, steps, lanes). States, and each block's words in the order of decoding."""
    blocks, steps, lanes = grid.shape
    x = np.full((blocks, lanes), _LOW)
    out, owner = [], []
    for t in range(steps - 1, -1, -1):
        f, c = freq[grid[:, t]], cum[grid[:, t]]
        full = x >= f << np.uint64(63 - SCALE)
        if full.any():
            out.append(x[full].astype(np.uint32))
            owner.append(np.nonzero(full)[0].astype(np.uint16))
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
    if not out:
        return x, np.zeros(0, np.uint32), np.zeros(blocks, np.int64)
    out, owner = np.concatenate(out[::-1]), np.concatenate(owner[::-1])
    return x, out[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=blocks)


def _decode(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    grid = np.empty((len(x), steps, x.shape[1]), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(steps):
        slot = x & mask
        s = slots[slot]
        grid[:, t] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + slot - cum[s]
        low = x < _LOW
        if low.any():
            rank = np.cumsum(low, axis=1)
            place = (at[:, None] + rank - 1)[low]
            x[low] = (x[low] << np.uint64(32)) | words[place]
            at += rank[:, -1]
    return grid


def encode_segment(ids: np.ndarray) -> bytes:
    """One segment of the file format."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, 0, 0, 0, LANES, SCALE)
    symbols, freq = frequencies(ids)
    number = np.zeros(int(symbols[-1]) + 1, np.uint32)
    number[symbols] = np.arange(len(symbols))
    f = freq.astype(np.uint64)
    c = np.cumsum(f) - f
    coded = number[ids]
    parts = []
    if whole := n // BLOCK:
        parts.append(_encode(coded[: whole * BLOCK].reshape(whole, BLOCK // LANES, LANES), f, c))
    if rest := n - whole * BLOCK:  # padded to whole steps with its own last symbol
        last = coded[whole * BLOCK :]
        parts.append(_encode(np.pad(last, (0, -rest % LANES), mode="edge").reshape(1, -1, LANES), f, c))
    states = np.concatenate([p[0] for p in parts]).astype("<u8").tobytes()
    begins = np.cumsum(np.concatenate([[0], *[p[2] for p in parts]])).astype("<u4").tobytes()
    sums = np.array([zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(blocks)], "<u4").tobytes()
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    words = np.concatenate([p[1] for p in parts]).astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, n, len(symbols), len(table), LANES, SCALE) + table + states + begins + sums + words


def decode_segment(data: bytes, only: range | None = None) -> np.ndarray:
    """ids of a segment, or of a run of its blocks; raises ValueError where a checksum differs."""
    magic, n, n_symbols, n_table, lanes, scale = _HEAD.unpack_from(data)
    if magic != MAGIC or scale != SCALE:
        raise ValueError("not a token segment")
    if not n:
        return np.zeros(0, np.uint32)
    blocks, at = -(-n // BLOCK), _HEAD.size + n_table
    table = np.frombuffer(zlib.decompress(data[_HEAD.size : at]), "<u4")
    symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:].astype(np.uint64)
    cum, slots = np.cumsum(freq) - freq, np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    states = np.frombuffer(data, "<u8", blocks * lanes, at).reshape(blocks, lanes)
    begins = np.frombuffer(data, "<u4", blocks + 1, at := at + blocks * lanes * 8)
    sums = np.frombuffer(data, "<u4", blocks, at := at + (blocks + 1) * 4)
    words = np.frombuffer(data, "<u4", int(begins[-1]), at + blocks * 4)
    wanted = only or range(blocks)
    whole = [b for b in wanted if (b + 1) * BLOCK <= n]
    out = []
    if whole:
        b = slice(whole[0], whole[-1] + 1)
        out.append(_decode(states[b].copy(), words, begins[b], BLOCK // lanes, freq, cum, slots).reshape(-1))
    if n % BLOCK and blocks - 1 in wanted:
        rest = n % BLOCK
        out.append(_decode(states[-1:].copy(), words, begins[-2:-1], -(-rest // lanes), freq, cum, slots).reshape(-1)[:rest])
    ids = symbols[np.concatenate(out)]
    for i, b in enumerate(wanted):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != sums[b]:
            raise ValueError(f"block {b} is damaged")
    return ids


def token_segments(docs: DataFrame, vocabulary: str, end_id: int = 0, segment_ids: int = SEGMENT) -> DataFrame:
    """The file's segments: shard, segment, doc_ids, n_tokens (of each, with the end id), n_ids, payload; shards ascend with doc_id."""
    spark = docs.sparkSession

    def encode(batches):
        from pyspark import TaskContext

        encoder, shard, segment = run_encoder(vocabulary), TaskContext.get().partitionId(), 0
        held, owners, counts, size = [], [], [], 0

        def close():
            payload = encode_segment(np.concatenate(held) if held else np.zeros(0, np.uint32))
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "doc_ids": owners, "n_tokens": counts, "n_ids": size, "payload": payload}], schema=kind)

        for batch in batches:
            for part in chunks(batch):
                ids, at = encoder.ids(*text_bytes(part.column("text")))
                ends = np.insert(ids, at[1:], end_id)
                n = np.diff(at) + 1
                held.append(ends)
                owners += part.column("doc_id").to_pylist()
                counts += n.tolist()
                size += len(ends)
                if size >= segment_ids:
                    yield close()
                    held, owners, counts, size, segment = [], [], [], 0, segment + 1
        if owners:
            yield close()

    kind = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, "shard int, segment int, doc_ids array<long>, n_tokens array<long>, n_ids long, payload binary")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["payload"]).astype("<u4")
                n = np.asarray(row["n_tokens"], np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row["shard"], np.int32)), pa.array(np.full(k, row["segment"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array(sums, pa.int64())],
                    names=["shard", "segment", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    docs = segments.select("shard", "segment", "doc_ids", "n_tokens", "payload").mapInArrow(decode, "shard int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long")
    sizes = segments.select("shard", "segment", "n_ids")  # without the payload; shards are as many as range partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("segment_start")).join(shards, "shard")
    return docs.join(starts, ["shard", "segment"]).select("doc_id", (F.col("shard_start") + F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(written(token_segments(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")), "token-files"))
