"""Prefix trie of conversations: every distinct sequence of first turns is a node, with its members and what sharing it saves.

Turns are told by the SHA-256 of role and text. A polynomial rolling fingerprint of every prefix comes from NumPy scans over
sorted range partitions, whose sums are carried from one partition to the next where a conversation spans several. Equal
depth and fingerprint make a candidate group. Its representative is the member with the smallest conv_id; every member's
last turn and the group of its prefix must be those of the representative, which by induction over depth compares whole
prefixes turn by turn. Members that differ are marked, marks are carried along their conversations, and groups are made anew
by fingerprint and marks until nothing differs.

The rollup needs no walk over depths. Every node belongs to its smallest member, and a node's subtree is what its members
own from its depth on; so a subtree's sums are sums over members of what each owns, less what the node's own smallest member
owns before. All groupings are combined before they are shuffled, joins are on a node or on a conversation and may be split
by Spark where one is frequent, and ids of a node's ends are hashed from chunks of a bounded size, in order.

Turns ascend by turn, null first, and by their digest where a number repeats; repeated rows are turns each for itself. Null
roles and texts are empty. Rows without conv_id are left out. Conversations without turns count at the root. Texts are taken
whole; other columns are ignored. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import n_partitions, scratch, written
from tidewater.llm.ordered import laid_out, numbered, runs, sums_before

SHARED, HEADS = 20, 4
#: Two primes under 2**31, each with a base: products and powers stay within 64 bits.
_PRIMES, _BASES = np.array([2_147_483_647, 2_147_483_629], np.uint64), np.array([1_103_515_245, 1_566_083_941], np.uint64)
_CHUNK = 4096  # ids of a node's ends in one row
_NODE = ["depth", "fp", "mark"]


def turns(table: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of conversations (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return table.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn"), digest.alias("digest"), words.cast("long").alias("words"))


def heads_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(table: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words, last): every conversation's turns from depth 1, and a row of depth 0."""
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(SHARED))
    laid = laid_out(written(turns(table), "turns"), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "turns-in-order")
    found = written(runs(laid, ["conv_id"]), "turn-runs")
    sizes = found.groupBy("conv_id").agg(F.max("total").alias("total"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    # what a conversation takes and what it leaves of its own, by run: no run is larger than a partition
    found = found.withColumns({"base": first, "h": heads_of(F.col("conv_id"))}).join(bases, "base", "left")
    found = found.withColumn("taken", F.least("h", F.coalesce("base_total", F.lit(0)))).drop("base", "base_total")
    rows = written(numbered(laid, found, ["conv_id"]), "turns-by-place")
    own = rows.where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "words", (F.col("place") + 1 == F.col("total")).alias("last"))
    convs = written(found.groupBy("conv_id", "h", "taken").agg(F.max("total").alias("total")).withColumn("base", first), "conversations")
    heads = rows.where(F.col("place") < HEADS - 1).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    copied = convs.where("taken > 0").join(heads, "base").where("place < taken")
    copied = copied.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words", ((F.col("place") + 1 == F.col("taken")) & (F.col("total") <= F.col("h"))).alias("last"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"), ((F.col("taken") == 0) & (F.col("total") <= F.col("h"))).alias("last"))
    return own.unionByName(copied).unionByName(roots)


def _powers(depth: np.ndarray, base: np.uint64, prime: np.uint64) -> np.ndarray:
    """base**depth, by squares."""
    out, square, left = np.ones(len(depth), np.uint64), base, depth.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % prime, out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def _scanned(rows: DataFrame, of: str) -> DataFrame:
    """rows with `terms` of the polynomial and `sums`, those of the conversation so far within the partition, each for two primes.

    of: a column of 16 bytes or more that tells a row's value; null: zero.
    """

    def run(batches):
        conv, carried = None, np.zeros(2, np.uint64)
        for batch in batches:
            ids, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            if not len(ids):
                continue
            values = np.frombuffer(b"".join((x or b"")[:16].ljust(16, b"\0") for x in batch.column(of).to_pylist()), "<u8").reshape(-1, 2)
            begin = np.append(True, ids[1:] != ids[:-1])
            start = np.maximum.accumulate(np.where(begin, np.arange(len(ids)), 0))
            columns = []
            for k, (prime, base) in enumerate(zip(_PRIMES, _BASES, strict=True)):
                terms = values[:, k] % prime * _powers(depth, base, prime) % prime
                total = np.cumsum(terms)
                total = (total - (total - terms)[start] + np.where((start == 0) & (ids == conv), carried[k], np.uint64(0))) % prime
                carried[k] = total[-1]
                columns += [terms, total]
            conv = ids[-1]
            arrays = [pa.array(c.astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "t0", "s0", "t1", "s1"])

    kind = StructType([*rows.schema.fields])
    for name in ("t0", "s0", "t1", "s1"):
        kind = kind.add(name, "long")
    keys = ["conv_id", "depth"]
    return rows.repartitionByRange(n_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, kind).withColumn("run", F.spark_partition_id())


def prefixes(rows: DataFrame, of: str, into: str, bits: int = 62) -> DataFrame:
    """rows with the fingerprint `into` of their prefix, and `into`_before, that of one turn less; of `bits` bits."""
    own = rows.columns
    got = written(_scanned(rows, of), "scanned")
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ends = got.groupBy("conv_id", "run").agg(F.min("depth").alias("from"), *(F.max_by(s, "depth").alias(s) for s in ("s0", "s1")))
    carried = ends.select("conv_id", "run", "from", *(F.sum(s).over(earlier).alias(f"c{s}") for s in ("s0", "s1")))
    got = got.join(carried.where(F.col("from") > 0).drop("from"), ["conv_id", "run"], "left")

    def told(less: bool) -> Column:
        parts = []
        for k, prime in enumerate(_PRIMES.tolist()):
            total = F.col(f"s{k}") + F.coalesce(f"cs{k}", F.lit(0)) - (F.col(f"t{k}") if less else 0)
            parts.append(F.pmod(total, F.lit(prime)))
        return F.shiftleft(parts[0], 31).bitwiseOR(parts[1]).bitwiseAND(F.lit((1 << bits) - 1))

    return got.select(*[c for c in own if c not in (into, f"{into}_before")], told(False).alias(into), told(True).alias(f"{into}_before"))


def _groups(members: DataFrame) -> DataFrame:
    """Candidate nodes: members that share depth, fingerprint and marks; differs: some member isn't as the representative."""
    told = ("digest", "fp_before", "mark_before")
    got = members.groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min(F.struct("conv_id", *told, "words")).alias("first"), *(f(c).alias(f"{f.__name__}_{c}") for c in told for f in (F.min, F.max)))
    differs = F.lit(False)
    for c in told:
        differs = differs | (F.col(f"min_{c}") != F.col(f"first.{c}")) | (F.col(f"max_{c}") != F.col(f"first.{c}"))
    return got.select(*_NODE, "n_convs", "first", differs.alias("differs"))


def verified(rows: DataFrame, bits: int = 62) -> tuple[DataFrame, DataFrame]:
    """Members and nodes of exact prefixes. bits: of the fingerprints; with few of them groups collide and are split."""
    members = prefixes(rows, "digest", "fp", bits).withColumns({"marks": F.lit(None).cast("binary"), "mark": F.lit(0).cast("long"), "mark_before": F.lit(0).cast("long")})
    while True:
        members = written(members, "members")
        nodes = written(_groups(members), "nodes")
        wrong = nodes.where("differs").select(*_NODE, "first")
        if not wrong.head(1):
            return members, nodes
        split = members.join(wrong, _NODE, "left")
        other = F.lit(False)
        for c in ("digest", "fp_before", "mark_before"):
            other = other | (F.col(c) != F.col(f"first.{c}"))
        told = F.unhex(F.sha2(F.concat_ws(",", F.hex("digest"), F.col("fp_before").cast("string"), F.col("mark_before").cast("string"), F.hex(F.coalesce("marks", F.lit(b"")))).cast("binary"), 256))
        split = split.withColumn("marks", F.when(F.coalesce(other, F.lit(False)), told).otherwise(F.col("marks"))).drop("first")
        members = prefixes(split, "marks", "mark")


def ends(members: DataFrame) -> DataFrame:
    """ends_sha256 of every node where conversations end: their ids, ascending, in chunks that one task hashes one by one."""
    keys = [*_NODE, "conv_id"]

    def joined(batches):
        held, key = [], None

        def row():
            return pa.RecordBatch.from_pylist([{**dict(zip(_NODE, key, strict=True)), "at": held[0], "ids": ",".join(map(str, held))}], kind)

        kind = pa.schema([*((c, pa.int64()) for c in [*_NODE, "at"]), ("ids", pa.string())])
        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in keys), strict=True):
                if held and (node != key or len(held) == _CHUNK):
                    yield row()
                    held = []
                key = node
                held.append(conv)
        if held:
            yield row()

    def hashed(batches):
        key, state = None, hashlib.sha256()

        def row():
            return pa.RecordBatch.from_pylist([{**dict(zip(_NODE, key, strict=True)), "ends_sha256": state.hexdigest()}], kind)

        kind = pa.schema([*((c, pa.int64()) for c in _NODE), ("ends_sha256", pa.string())])
        for batch in batches:
            for *node, ids in zip(*(batch.column(c) for c in [*_NODE, "ids"]), strict=True):
                node = [x.as_py() for x in node]
                if node != key:
                    if key:
                        yield row()
                    key, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if key:
            yield row()

    node = ", ".join(f"{c} long" for c in _NODE)
    last = members.where("last").select(*keys).repartitionByRange(n_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)
    chunks = last.mapInArrow(joined, f"{node}, at long, ids string")
    return chunks.repartition(n_partitions(members.sparkSession), *_NODE).sortWithinPartitions(*_NODE, "at").mapInArrow(hashed, f"{node}, ends_sha256 string")


def trie(table: DataFrame, bits: int = 62) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch(table.sparkSession):
        with scratch(table.sparkSession):
            rows = written(rebuilt(table), "rebuilt", lasting=True)
        members, nodes = verified(rows, bits)
        nodes = nodes.select(*_NODE, "n_convs", F.col("first.conv_id").alias("conv_id"), F.col("first.fp_before").alias("fp_before"), F.col("first.mark_before").alias("mark_before"), ((F.col("n_convs") - 1) * F.col("first.words")).alias("saved"))
        children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("fp_before").alias("fp"), F.col("mark_before").alias("mark")).agg(F.count("*").alias("n_children"))
        nodes = written(nodes.join(children, _NODE, "left").na.fill(0, ["n_children"]), "nodes-with-children")
        owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
        below = members.select("conv_id", *_NODE).join(owned, "conv_id").groupBy(*_NODE).agg(F.sum("saved").alias("members_saved"), F.sum("leaves").alias("n_leaves"))
        before = sums_before(nodes, ["conv_id"], "depth", "saved", "nodes-in-order")
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("fp_before"), F.col("mark").alias("mark_before"), F.col("conv_id").alias("parent_conv_id"))
        got = written(before.join(below, _NODE).join(ends(members), _NODE, "left"), "nodes-with-sums")
        got = got.join(parents, ["depth", "fp_before", "mark_before"], "left")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        got = got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("members_saved") - F.col("sum_before")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
        return written(got, "trie", lasting=True)


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
