"""Merkle manifest of a dataset: a digest for each row, a binary tree for each language, one root over all.

Leaves are hashed where the table is scanned; only digests and keys are sorted and numbered. Aligned blocks of 2**BLOCK
consecutive nodes are traversed in postorder, a block in one task: the recursion returns a subtree's digest and, while it
unwinds, appends the sibling to the path of every leaf below. The blocks' roots are the nodes of the next traversal, until
each tree has one node; the trees' roots form one more tree. A path down is then a join of blocks with the blocks above.

Leaves of a tree ascend by key, null first, and by digest where keys repeat, so that rows in any order give one manifest.
Every column may be null; a null language is a tree of its own, before the others. Repeated rows are leaves each for
itself. Texts are hashed whole, however long. A tree of one leaf has that leaf as its root; one tree's root is the root of
all. Rows without doc_id are never tampered with. Other columns of the table are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tidewater.llm.common import documents, scratch, written
from tidewater.llm.ordered import laid_out, numbered, runs

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one task climbs: a block has up to 2**BLOCK nodes.
BLOCK = 10
TAMPERED = 7


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields, each `-` if null, else its length in UTF-8 bytes, a colon, and itself."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(told, fields))


def climbed(digests: list[str], levels: int) -> tuple[str, list[list[str]]]:
    """Root of up to 2**levels nodes, and each node's siblings from below: `<` or `>` and a digest, or `` where it has none."""
    paths: list[list[str]] = [[] for _ in digests]

    def subtree(lo: int, hi: int, level: int) -> str:
        if not level:
            return digests[lo]
        middle = min(lo + (1 << level - 1), hi)
        left = subtree(lo, middle, level - 1)
        right = subtree(middle, hi, level - 1) if middle < hi else ""
        for path in paths[lo:middle]:
            path.append(right and f">{right}")
        for path in paths[middle:hi]:
            path.append(f"<{left}")
        return hashlib.sha256((left + right).encode()).hexdigest()

    return subtree(0, len(digests), levels), paths


def _traversed(nodes: DataFrame, block: int) -> DataFrame:
    """nodes (tree, place, total, digest, ...) with `siblings` within their blocks and `top`, the block's root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        levels = min(block, (table["total"][0].as_py() - 1).bit_length())
        top, paths = climbed(table["digest"].to_pylist(), levels)
        return table.drop_columns(["block"]).append_column("siblings", pa.array(paths, pa.list_(pa.string()))).append_column("top", pa.array([top] * len(table), pa.string()))

    kind = StructType([*nodes.schema.fields]).add("siblings", ArrayType(StringType())).add("top", "string")
    return nodes.withColumn("block", F.shiftright("place", block)).groupBy("tree", "block").applyInArrow(run, kind)


def _climb(nodes: DataFrame, block: int) -> list[DataFrame]:
    """Tables of the traversals, from the leaves up; in the last every tree is one block."""
    found = []
    while True:
        found.append(written(_traversed(nodes, block), "merkle-blocks"))
        if (found[-1].agg(F.max("total")).first()[0] or 0) <= 1 << block:
            return found
        first = found[-1].where(F.col("place") % (1 << block) == 0)
        nodes = first.select("tree", F.shiftright("place", block).alias("place"), F.ceil(F.col("total") / (1 << block)).alias("total"), F.col("top").alias("digest"))


def _paths(found: list[DataFrame], block: int) -> DataFrame:
    """The leaves' table with whole paths and the tree's root as top; the tables from the top down, each joined to its blocks."""
    got = found[-1]
    for below in reversed(found[:-1]):
        above = got.select("tree", F.col("place").alias("block"), F.col("siblings").alias("upper"), F.col("top").alias("root_above"))
        got = below.withColumn("block", F.shiftright("place", block)).join(above, ["tree", "block"])
        got = got.withColumn("siblings", F.concat("siblings", "upper")).withColumn("top", F.col("root_above")).drop("block", "upper", "root_above")
    return got


def _ordered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    laid = laid_out(nodes, ["tree"], order, "merkle-order")
    return numbered(laid, runs(laid, ["tree"]), ["tree"])


def folded(start: Column, siblings: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    other = lambda s: F.substring(s, 2, 64)
    return F.aggregate(siblings, start, lambda now, s: F.when(s.startswith("<"), digest(other(s), now)).otherwise(digest(now, other(s))))


def manifest(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """leaves (tree string, key, digest, ...) with subroot, root and siblings up to the root. Trees ascend bytewise."""
    with scratch(leaves.sparkSession):
        found = _climb(_ordered(written(leaves, "leaves"), [F.col("key").asc_nulls_first(), F.col("digest")]), block)
        roots = found[-1].where("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("top").alias("digest"))
        upper = _paths(_climb(_ordered(roots, [F.col("key")]), block), block)
        upper = upper.select(F.col("key").alias("tree"), F.col("siblings").alias("beyond"), F.col("top").alias("root"))
        top = found[-1].join(upper, "tree").withColumn("siblings", F.concat("siblings", "beyond"))
        top = top.withColumn("top", F.concat("top", "root")).drop("beyond", "root")  # both roots go down as one
        got = _paths([*found[:-1], top], block)
        got = got.withColumn("subroot", F.substring("top", 1, 64)).withColumn("root", F.substring("top", 65, 64))
        return written(got.drop("tree", "place", "total", "top"), "manifest", lasting=True)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, key, digest, tampered): the digest of each document, and that of its tampered form."""
    fields = dict(zip(FIELDS, map(F.col, FIELDS), strict=True))
    more = (fields["n_chars"].cast("decimal(38,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    digest_ = leaf(list(fields.values()))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").alias("key"), digest_.alias("digest"), F.when(hit & F.col("n_chars").isNotNull(), leaf(list((fields | {"n_chars": more}).values()))).alias("tampered"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = manifest(leaves_of(documents(spark, sf_dir)))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.substring(s, 2, 64)), "").cast("binary"), 256)
    got = got.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("siblings")))
    return got.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
