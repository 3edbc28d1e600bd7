"""A training corpus from raw documents: quality, one of each group of near-duplicates, repeats cut, packed sequences.

Each stage takes what its predecessor kept, as written and read again. Only documents go in; every stage but the last
returns their columns, with whatever other columns the table has, under any names: what a stage computes for itself has a
name that the table doesn't use. When a stage's table is there, the tables it made on the way and its input are removed.

Null texts count as empty, and empty ones go through: the quality model scores them like any text, they are nobody's near
copies, lose nothing and are packed as one end id. Texts are taken whole, however long. A row without doc_id is kept like
any other; among near copies it comes after those with one. Rows that repeat both doc_id and text are one document, of
which near_duplicates keeps one; other rows of one doc_id are documents each for itself. Of near copies with the smallest
doc_id in common, that of the smaller text hash stays. A score at the threshold is accepted. Without labels of both kinds
every score is 0.5 and nothing is accepted. An empty table gives no rows.

Each stage sets the session's Arrow batches to BATCH_ROWS rows: texts are wide, and a batch is held by both the executor and
its Python worker. Results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import op1_jaccard, op3_repeats, op8_quality, op10_packing
from tidewater.llm.common import documents, new_path, remove, scratch, unused, written

BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """From now on, as what a stage returns is run after it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is accepted; the model learns from labels that aren't held out."""
    _small_batches(spark)
    (column,) = unused(docs, "quality_score")
    got = op8_quality.score(docs, op8_quality.trained(spark, docs, sf_dir), column)
    return got.where(F.col(column) >= op8_quality.ACCEPT).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a Jaccard similarity of 0.75 on 5-word shingles."""
    _small_batches(spark)
    return op1_jaccard.without_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier one has; texts that lose nothing stay as they are."""
    _small_batches(spark)
    columns = unused(docs, *op3_repeats.ADDED)
    cut = op3_repeats.remove_repeats(docs, columns=columns)
    lost = F.col(columns[2]) > 0
    cut = cut.withColumn("text", F.when(lost, F.col(columns[0])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(lost, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 1024."""
    import public_tokenizers

    _small_batches(spark)
    return op10_packing.pack(written(op10_packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: The stages' rows depend on trained weights and on a tokenizer, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path=path)
        if before:
            remove(spark, before)
        before = path
    return docs
