"""Document fingerprints as invertible Bloom lookup sketches, in SQL expressions alone.

A text's paragraphs (lines and sentences, distinct) have 64-bit digests. A sketch has three subtables of `size` cells; each
digest falls in one cell of each, which holds a count, the XOR of digests and the XOR of their checks. A text's fingerprint is
the sketch of the smallest power of two that isn't below its number of paragraphs (`LEAST` at least), as a sorted list of the
cells in use; folded in half it is the sketch of half the size. Two sketches of one size subtract cell by cell: common
paragraphs cancel, and peeling takes digests out of cells that hold one until nothing is left, which recovers the paragraphs
of either side alone. Two texts are compared at the smaller one's size, where that can hold both, else at the next that can;
a pair that gets stuck is done again at twice the size, until none is. Likeness is the common paragraphs' share of the larger
text's (two empty texts: 1), from the digests recovered.

Null texts are empty. Rows in order: descending doc_id, null last; rows of one doc_id by descending text. A single row is
its own next. Texts are taken whole, of any length: cells are rows, so memory doesn't grow with a text's paragraphs but for
the arrays of its digests. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import documents, n_partitions, scratch, written

LEAST = 16
#: Rounds between looking whether anything is left to peel: each subtable twice.
ROUNDS = 6
_LEAST_ID = -(1 << 63)


def digests(text: str) -> str:
    """Distinct digests of a text's paragraphs."""
    pieces = f"filter(split({text}, '\\\\n+|(?<=[.!?])\\\\s+'), x -> x <> '')"
    return f"array_distinct(transform({pieces}, x -> xxhash64(x)))"


def size_for(count: str) -> str:
    """Cells of a subtable: the least power of two that isn't below count."""
    return f"greatest({LEAST}L, shiftleft(1L, cast(ceil(log2(greatest({count}, 1))) as int)))"


def _cell(subtable: int, size: str, k: str, n: str) -> str:
    """The cell of a subtable that digest k falls in, with count n."""
    return f"named_struct('i', {subtable} * {size} + (xxhash64({k}, {subtable}) & ({size} - 1)), 'n', {n}, 'k', {k}, 'c', xxhash64({k}, 7))"


def _with(value: str, name: str, body: str) -> str:
    """body with `name` standing for value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sketch(keys: str, size: str) -> str:
    """The sketch of an array of digests: its cells in use, by place; those of one place are added up, by where each begins."""
    entries = f"flatten(transform({keys}, k -> array({', '.join(_cell(t, size, 'k', '1') for t in range(3))})))"
    begins = "filter(sequence(1, size(c)), p -> p = 1 or element_at(c, p).i <> element_at(c, p - 1).i)"
    add = "named_struct('i', x.i, 'n', t.n + x.n, 'k', t.k ^ x.k, 'c', t.c ^ x.c)"
    one = f"aggregate(slice(c, p, coalesce(try_element_at(b, j + 2), size(c) + 1) - p), named_struct('i', 0L, 'n', 0, 'k', 0L, 'c', 0L), (t, x) -> {add})"
    return _with(f"array_sort({entries})", "c", f"if(size(c) = 0, c, {_with(begins, 'b', f'transform(b, (p, j) -> {one})')})")


def shown(size: str, cells: str) -> str:
    """A sketch as a string: its size, then place, count, digests and checks of its cells."""
    return f"concat_ws(' ', {size}, array_join(transform({cells}, y -> concat_ws(':', hex(y.i), y.n, hex(y.k), hex(y.c & 4294967295))), ' '))"


def _peeled(cells: DataFrame) -> DataFrame:
    """ROUNDS rounds over cells (row_id, which, size, i, n, k, c): cells of one subtable that hold one digest give it up, to a
    row with i < 0, and take it out of the two other subtables. All cells of a row_id must be in one partition; nothing is shuffled."""
    key = ["row_id", "which", "size"]
    for r in range(ROUNDS):
        own, others = r % 3, [t for t in range(3) if t != r % 3]
        pure = f"i >= 0 and i div size = {own} and abs(n) = 1 and c = xxhash64(k, 7)"
        out = f"array(named_struct('i', -1 - i, 'n', n, 'k', k, 'c', 0L), {_cell(others[0], 'size', 'k', '-n')}, {_cell(others[1], 'size', 'k', '-n')})"
        cells = _added(cells.selectExpr(*key, f"inline(if({pure}, {out}, array(named_struct('i', i, 'n', n, 'k', k, 'c', c)))) as (i, n, k, c)"))
    return cells


def _added(cells: DataFrame) -> DataFrame:
    sums = F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")
    return cells.groupBy("row_id", "which", "size", "i").agg(*sums).where("n <> 0 or k <> 0 or c <> 0")


def recovered(pairs: DataFrame, first_size: str | None = None, both: bool = True) -> DataFrame:
    """row_id, which, digest, first: every digest that one side of a pair alone has; first: the first side has it.

    pairs: row_id, which (together a pair's name), keys_a, keys_b. first_size: that of the first try, the text's own unless given.
    Without `both`, the digests of the second side are peeled but not kept.
    """
    parts, tries = n_partitions(pairs.sparkSession), []
    fits = f"greatest(least({size_for('size(keys_a)')}, {size_for('size(keys_b)')}), {size_for('(size(keys_a) + size(keys_b)) / 2')})"
    todo = pairs.selectExpr("row_id", "which", f"{first_size or fits} as size", "keys_a", "keys_b")
    while True:
        signs = "concat(array_repeat(1, size(keys_a)), array_repeat(-1, size(keys_b)))"
        rows = todo.repartition(parts, "row_id").selectExpr("row_id", "which", "size", f"inline(arrays_zip(concat(keys_a, keys_b), {signs})) as (k, sign)")
        cells = _added(rows.selectExpr("row_id", "which", "size", f"inline(array({', '.join(_cell(t, 'size', 'k', 'sign') for t in range(3))})) as (i, n, k, c)"))
        out, left = [], None
        while True:
            done = _peeled(cells).withColumn("i", F.greatest("i", F.lit(-1).cast("long")))
            done = written(done if both else done.where("i >= 0 or n > 0"), "cells")
            out.append(done.where("i < 0").select("row_id", "which", "n", "k"))
            cells = done.where("i >= 0")
            before, left = left, done.where("i >= 0").count()
            if left in (0, before):  # nothing is left, or nothing was peeled
                break
            cells = cells.repartition(parts, "row_id")
        found = out[0]
        for more in out[1:]:
            found = found.unionByName(more)
        if not left:
            tries.append(found)
            break
        stuck = written(cells.select("row_id", "which").distinct(), "stuck")
        tries.append(found.join(stuck, ["row_id", "which"], "left_anti"))
        todo = written(todo.join(stuck, ["row_id", "which"], "left_semi").withColumn("size", F.col("size") * 2), "again")
    got = tries[0]
    for more in tries[1:]:
        got = got.unionByName(more)
    return got.select("row_id", "which", F.col("k").alias("digest"), (F.col("n") > 0).alias("first"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and keys of each row, and next_text and next_keys of the one after it.

    Rows go to as many ranges of doc_id as the shuffle has partitions; only each range's first row meets another range.
    """
    parts = n_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("id"))
    bounds = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    held = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]) if bounds else F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumn("part", F.size(F.filter(held, lambda b: b < F.col("id"))))
    heads = rows.groupBy("part").agg(F.max("id").alias("id"))  # one row of two numbers a range, at most `parts`
    texts = rows.join(F.broadcast(heads), ["part", "id"]).groupBy("part").agg(F.max("text").alias("head_text"))
    down = Window.orderBy(F.desc("part"))
    follows = heads.select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(down), F.max("part").over(Window.partitionBy())).alias("part"))
    ahead = texts.join(follows, "part").select(F.col("before").alias("part"), "head_text")
    order = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("text"))
    rows = rows.withColumn("keys", F.expr(digests("text")))
    found = rows.withColumn("after", F.lead("text").over(order)).withColumn("after_keys", F.lead("keys").over(order)).join(ahead, "part", "left")
    return found.select("doc_id", "text", "keys", F.coalesce("after", "head_text").alias("next_text"), F.coalesce("after_keys", F.expr(digests("head_text"))).alias("next_keys"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row."""
    third = "cast(length(text) div 3 as int)"
    rows = with_next(docs).withColumn("edited", F.expr(f"concat(left(text, length(text) - {third}), left(next_text, {third}))"))
    rows = rows.selectExpr("doc_id", "cast(length(text) as long) as n_chars", "keys", "next_keys", f"inline(array(named_struct('edited_sha256', sha2(cast(edited as binary), 256), 'edited_keys', {digests('edited')})))")
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "paragraphs")
    both = "array(named_struct('which', 0, 'keys_a', keys, 'keys_b', edited_keys), named_struct('which', 1, 'keys_a', keys, 'keys_b', next_keys))"
    with scratch(docs.sparkSession):
        alone = recovered(rows.selectExpr("row_id", f"inline({both})"), both=False).groupBy("row_id")
        alone = written(alone.agg(*[F.count_if(F.col("which") == w).alias(f"alone_{w}") for w in (0, 1)]), "alone", lasting=True)
    rows = rows.join(alone, "row_id", "left")
    rows = rows.selectExpr("*", f"inline(array(named_struct('size', {size_for('size(keys)')}, 'edited_size', {size_for('size(edited_keys)')})))")
    rows = rows.selectExpr("*", f"inline(array(named_struct('cells', {sketch('keys', 'size')}, 'edited_cells', {sketch('edited_keys', 'edited_size')})))")

    def near(which: int, other: str) -> str:
        share = f"(size(keys) - coalesce(alone_{which}, 0)) / cast(greatest(size(keys), size({other})) as double)"
        return f"case when size(keys) = 0 and size({other}) = 0 then 1D when size(keys) = 0 or size({other}) = 0 then 0D else {share} end"

    return rows.selectExpr(
        "doc_id",
        "n_chars",
        "edited_sha256",
        f"{shown('size', 'cells')} as fingerprint",
        f"{shown('edited_size', 'edited_cells')} as edited_fingerprint",
        f"{near(0, 'edited_keys')} as near_edited",
        f"{near(1, 'next_keys')} as near_next",
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
