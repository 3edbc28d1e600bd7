"""Exact repeats across documents, by fixed-block anchors.

Every document's non-overlapping blocks of half a window are the index; the rolling half-windows of all documents probe it
by hash, in buckets of the hash. Where a block and a probe of different documents meet, the hit is extended: a repeat of a
whole window holds an aligned block of either document, so all whole windows around hits, and no others, are compared, by
hash again; the first document that a window starts in is found, and later ones lose the words it covers. Windows that
follow each other make up the maximal repeats. Buckets are packed column-wise (6 bytes of hash, a place) and as many as the
shuffle's partitions call for, so neither a frequent passage nor a group of copies makes pairs.

Rows are told apart by doc_id and text; rows of one doc_id are one document and don't take from each other. A null doc_id
counts as the largest; rows that repeat doc_id and text are cut alike. Null and empty texts have no words; texts are taken
whole, however long. Other columns are kept. An empty table gives no rows. Two different
windows share a 64-bit hash with a chance of about n**2 / 2**49 (48 bits compared) over n candidate windows of a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import chunks, documents, mix, n_partitions, scratch, split_by_keys, text_bytes, windows, words, written

WINDOW = 50
#: Bytes of text whose windows are worked out at once; they take many times as much memory.
_AT_ONCE = 1 << 20
ADDED = ("kept_text", "kept_words", "removed_words")
_LAST = (1 << 63) - 1
_PACKED = "bucket int, ids binary, keys binary, counts binary, low binary, high binary, place_low binary, place_high binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "keys", "counts", "low", "high", "place_low", "place_high"))])
_STARTS = "doc_id long, key long, places array<int>"
_STARTS_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("places", pa.list_(pa.int32()))])


def _keys():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, key, text): null ids last; key tells texts of one doc_id apart."""
    id_, key = _keys()
    return docs.select(id_.alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("doc_id").to_numpy(), part.column("key").to_numpy()


def _pack(ids, keys, owner, place, h, bucket):
    """Rows of _PACKED from windows in the order of their documents; owner: each window's document by number."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else [0]
    rows = []
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        at = order[x:y]
        own = owner[at]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        docs = own[new]
        hashes = (b"", b"") if h is None else (h[at].astype("<u4").tobytes(), (h[at] >> np.uint64(32)).astype("<u2").tobytes())
        rows.append((int(bucket[at[0]]), ids[docs].tobytes(), keys[docs].tobytes(), np.diff(np.append(new, len(at))).astype("<u4").tobytes(), *hashes, place[at].astype("<u2").tobytes(), (place[at] >> 16).astype("<u2").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _PACKED_ARROW.types, strict=True)], schema=_PACKED_ARROW)


def _of_hash(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)


def _unpack(table: pa.Table):
    col = {n: b"".join(table.column(n).to_pylist()) for n in table.column_names if n != "bucket"}
    ids, keys = np.frombuffer(col["ids"], np.int64), np.frombuffer(col["keys"], np.int64)
    owner = np.repeat(np.arange(len(ids)), np.frombuffer(col["counts"], "<u4"))
    h = np.frombuffer(col["low"], "<u4").astype(np.uint64) | np.frombuffer(col["high"], "<u2").astype(np.uint64) << np.uint64(32)
    return ids, keys, owner, np.frombuffer(col["place_low"], "<u2").astype(np.int32) | np.frombuffer(col["place_high"], "<u2").astype(np.int32) << 16, h


def _grouped(h: np.ndarray):
    """Order that brings equal hashes together, where each run begins, and each sorted row's run."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin = np.append(True, s[1:] != s[:-1])
    return order, np.flatnonzero(begin), np.cumsum(begin) - 1


def _found(packed: DataFrame, choose) -> DataFrame:
    """Places per document that `choose` keeps within each bucket; they go back to their documents packed by document hash."""
    parts = n_partitions(packed.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        ids, keys, owner, place, h = _unpack(table)
        take = np.sort(choose(ids[owner], h))
        home = _of_hash(mix(mix(ids.view(np.uint64)) ^ keys.view(np.uint64)), parts)
        return pa.Table.from_batches([_pack(ids, keys, owner[take], place[take], None, home[owner[take]])])

    def gather(table: pa.Table) -> pa.Table:
        ids, keys, owner, place, _ = _unpack(table)
        order = np.lexsort((keys, ids))
        new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0))
        number = np.empty(len(ids), np.int64)
        number[order] = np.cumsum(new) - 1
        docs, by = order[new], number[owner]
        at = np.append(0, np.cumsum(np.bincount(by, minlength=len(docs))))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place[np.argsort(by, kind="stable")], pa.int32()))
        return pa.Table.from_arrays([pa.array(ids[docs]), pa.array(keys[docs]), lists], schema=_STARTS_ARROW)

    return packed.groupBy("bucket").applyInArrow(run, _PACKED).groupBy("bucket").applyInArrow(gather, _STARTS)


def _hits(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Windows whose hash (without its lowest bit) also has a block (lowest bit) and comes from more than one document."""
    block, h = (h & np.uint64(1)).astype(bool), h >> np.uint64(1)
    order, begin, run = _grouped(h)
    own = ids[order]
    good = np.logical_or.reduceat(block[order], begin) & (np.minimum.reduceat(own, begin) < np.maximum.reduceat(own, begin))
    return order[good[run]]


def _later(ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Windows that a document with a smaller id has too."""
    order, begin, run = _grouped(h)
    own = ids[order]
    return order[own > np.minimum.reduceat(own, begin)[run]]


def _inside(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of n words that stay within a text: by first word of all; their text and their place in it."""
    room = np.maximum(np.diff(at) - n + 1, 0)
    owner = np.repeat(np.arange(len(room)), room)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)
    return at[owner] + place, owner, place


def repeat_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, places: words at which windows begin that a document with a smaller doc_id has too. docs: as keyed() gives."""
    half = window // 2
    buckets = 3 * n_partitions(docs.sparkSession)

    def probes(batches):
        for batch in batches:
            for part in chunks(batch, most=_AT_ONCE):
                h, _, _, at = words(*text_bytes(part.column("text")))
                first, owner, place = _inside(at, half)
                got = windows(h, half)[first]
                yield _pack(*_ids(part), owner, place, got & ~np.uint64(1) | (place % half == 0).astype(np.uint64), _of_hash(got, buckets))

    hits = written(_found(docs.mapInArrow(probes, _PACKED), _hits), "anchor-hits")

    def extended(batches):
        for batch in batches:
            for part in chunks(batch, most=_AT_ONCE):
                h, _, _, at = words(*text_bytes(part.column("text")))
                first, owner, place = _inside(at, window)
                lists = part.column("places")
                hit = at[:-1].repeat(np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
                edge = np.bincount(np.concatenate([np.maximum(hit - half, 0), [len(h) + 1]]), minlength=len(h) + 2)
                edge[: len(h) + 1] -= np.bincount(hit + 1, minlength=len(h) + 1)[: len(h) + 1]
                near = (np.cumsum(edge) > 0)[first]
                got = windows(h, window)[first[near]] if len(first) else np.zeros(0, np.uint64)
                yield _pack(*_ids(part), owner[near], place[near], got, _of_hash(got, buckets))

    near, _ = split_by_keys(docs, hits, ["doc_id", "key"])
    return _found(near.join(hits, ["doc_id", "key"]).mapInArrow(extended, _PACKED), _later)


def remove_repeats(docs: DataFrame, window: int = WINDOW, columns: tuple[str, str, str] = ADDED) -> DataFrame:
    """docs with its kept text, kept and removed words behind its own columns, named by `columns`; kept words are joined by one space.

    Columns that docs has by these names give way.
    """
    names = [c for c in docs.columns if c not in columns]
    with scratch(docs.sparkSession):
        starts = written(repeat_starts(keyed(docs), window), "repeat-starts", lasting=True).withColumnsRenamed({"doc_id": "k_doc", "key": "k_text"})
    id_, key = _keys()
    joined = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(names)], id_.alias("k_doc"), key.alias("k_text"))
    cut_from, whole = split_by_keys(joined, starts, ["k_doc", "k_text"])
    joined = cut_from.join(starts, ["k_doc", "k_text"], "left").unionByName(whole.withColumn("places", F.lit(None).cast("array<int>"))).drop("k_doc", "k_text")
    text = f"own_{names.index('text')}"
    kind = StructType([f for f in joined.schema if f.name != "places"]).add(columns[0], "string").add(columns[1], "long").add(columns[2], "long")

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, text):
                kept, n_kept, n_gone = [], [], []
                for t, places in zip(part.column(text).to_pylist(), part.column("places"), strict=True):
                    found = (t or "").encode().split()
                    gone = np.zeros(len(found), bool)
                    if places.is_valid:
                        at = places.values.to_numpy()
                        edge = np.bincount(at, minlength=len(found) + 1) - np.bincount(at + window, minlength=len(found) + 1)
                        gone = np.cumsum(edge[:-1]) > 0
                        found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(found).decode())
                    n_kept.append(len(found))
                    n_gone.append(int(gone.sum()))
                own = part.drop_columns(["places"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(kept, pa.string()), pa.array(n_kept, pa.int64()), pa.array(n_gone, pa.int64())], names=[*own.schema.names, *columns])

    return joined.mapInArrow(cut, kind).withColumnsRenamed({f"own_{i}": c for i, c in enumerate(names)})


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", (F.col("kept_words") + F.col("removed_words")).alias("n_words"), F.col("removed_words").alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
