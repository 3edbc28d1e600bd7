"""What the corpus operators share: tables between steps, Arrow batches, vectorised words and their hashes."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master gets a temporary one where none is set."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path:
        return path
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidewater-')}")
    return context.getCheckpointDir()


_SCOPE: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("tables that end with a scope", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written in here are removed at its end; `lasting` ones with the scope around it, if any."""
    paths: list[str] = []
    token = _SCOPE.set((*_SCOPE.get(), paths))
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Shuffle files of a query made and run in here go when it ends."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, lasting: bool = False, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts the lineage and survives lost executors.

    A table at a given path belongs to no scope.
    """
    spark, scopes = df.sparkSession, _SCOPE.get()
    if path is None:
        path = new_path(spark, name)
        if len(scopes) > lasting:
            scopes[-1 - lasting].append(path)
    with shuffles_cleaned(spark):  # its shuffle files go when the table is there
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Hashes of keys, 8 bytes each, up to which they are sent to every task; beyond, rows are shuffled to their keys.
MOST_SENT = 2_000_000


def split_by_keys(rows: DataFrame, marks: DataFrame, keys: list[str], most: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """rows that may have a mark, and rows that have none: wide rows without a mark needn't be shuffled to a join with marks.

    marks is a written table whose keys are not null. Keys are told apart by hash, so that a few of the first may have no mark
    either: the join with marks is still to be made. With over `most` marks all rows are among the first.
    """
    from pyspark.sql import functions as F

    if marks.limit(most + 1).count() > most:
        return rows, rows.limit(0)
    name = unused(rows, "key_hash")[0]
    sent = F.broadcast(marks.select(F.xxhash64(*keys).alias(name)).distinct())  # its size is checked above
    hashed = rows.withColumn(name, F.xxhash64(*keys))
    return hashed.join(sent, name, "left_semi").drop(name), hashed.join(sent, name, "left_anti").drop(name)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores behind it as it takes for df not to have it."""
    held = {c.lower() for c in df.columns}

    def one(name: str) -> str:
        return one(f"{name}_") if name.lower() in held else name

    return tuple(map(one, names))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(buf) else buf, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch of about `most` bytes of text each; a longer text comes alone and whole."""
    lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (the splitmix steps)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def noise(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE, _PLACE = noise(256, 11), noise(256, 12)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = noise(1 << (n - 1).bit_length(), 12)
    return _PLACE


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Words [^\\x20\\x09-\\x0D]+ of concatenated texts: 64-bit hashes, byte starts, byte ends, and n + 1 word offsets by text.

    The hash is multilinear over (byte, place in word), finalised with the length; 64 bits, so for 10**6 distinct
    words two collide with a chance of about 3e-8.
    """
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(buf))]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    at = np.flatnonzero(word)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    first = np.searchsorted(at, starts)
    lens = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lens)
    b = buf[at]
    h = _BYTE[_LOWER[b] if lower else b]
    h *= _places(int(lens.max()))[place]
    h = np.add.reduceat(h, first)
    return mix(h + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts, starts + lens, np.searchsorted(starts, offsets)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by their first word; built from doubled runs."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    run, size, got, have = h, 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            got = run if got is None else _joined(got[: len(h) - have - size + 1], run[have : have + len(h) - have - size + 1])
            have += size
        rest >>= 1
        if rest:
            run = _joined(run[:-size], run[size:])
            size *= 2
    return got[: len(h) - n + 1]


def crc32(data) -> int:
    import zlib

    return zlib.crc32(data) & 0xFFFFFFFF
