"""Near-duplicate join on 5-word shingles: count-vector trees under an exact Jaccard threshold.

1. Equal sets of shingles become one class. The classes' shingles meet in buckets of their hash, so each is known to be in one
   class, in two or three, in four to seven, and so on; that, then the hash, is the order of all shingles, the rarest first.
2. Two sets over the threshold t both hold one of the other's first `n - ceil(t n) + 1` shingles in this order. A class whose
   own shingles, which no other class has, fill that prefix links with nothing and is done. The others list what follows.
3. A class is at home with the commonest shingle that it lists. Homes are cut into blocks of `BLOCK` classes; every block of a
   home also holds its `LEADERS`, so that a large group of near copies is joined through them and never makes all its pairs.
   In a block, shingles are hashed into groups, and the counts by group are a set's point. The points are a tree of bounding
   maxima: the overlap of two sets is at most the sum of coordinate minima, so pairs of nodes that can't reach the threshold
   by this sum or by size are skipped; surviving pairs are verified on the whole sets. A block gives a spanning star of links.
4. What is still apart meets again: blocks are formed anew within a home, those of one large component alone, and pairs of
   blocks that list a common shingle are compared, unless they are one component, met before, or their bounding maxima or
   sizes keep them apart. Only the pairs of blocks that pass are dealt the sets, each once a pair of blocks.

Texts without words are empty and link with nothing; null texts too. With fewer than five words the whole sequence is the
only shingle. Texts are taken whole, of whatever length; a set's memory grows with it, and a block is bounded by shingles
(`BLOCK_SHINGLES`) as well as by classes. Rows are documents each for itself, also with equal doc_id; a component's id is the
smallest doc_id in it that is not null. Similarities of exactly the threshold link. Other columns are ignored, whatever their
names; an empty table gives no rows. Shingles are compared by 48 bits of their hash: for two sets of 1000 shingles an
accidental match has a chance of 4e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, mix, n_partitions, scratch, split_by_keys, text_bytes, windows, words, written
from tidewater.llm.components import components, roots

WORDS, GROUPS, LEAF = 5, 128, 32
BLOCK, BLOCK_SHINGLES, LEADERS = 256, 1 << 20, 4
NUMERATOR, DENOMINATOR = 75, 100
_BITS = np.uint64((1 << 48) - 1)
_COLUMNS = 8192


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of each text, ascending, and each one's text number."""
    h, _, _, at = words(buf, offsets, lower=True)
    n = np.diff(at)
    room = np.maximum(n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), room)
    got = windows(h, k)[at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)] if len(owner) else h[:0]
    few = np.flatnonzero((n > 0) & (n < k))
    whole = [mix(np.append(h[at[i] : at[i + 1]], np.uint64(n[i])) * np.arange(1, n[i] + 2, dtype=np.uint64)).sum(dtype=np.uint64) for i in few.tolist()]
    owner = np.concatenate([owner, few])
    got = mix(np.concatenate([got, np.array(whole, np.uint64)])) & _BITS
    order = np.lexsort((got, owner))
    owner, got = owner[order], got[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
    return got[new], owner[new]


def _sets(part: pa.RecordBatch):
    """Shingles, their text numbers, and by text: size and class (a digest of the set)."""
    h, owner = shingles(*text_bytes(part.column("text")))
    n = np.bincount(owner, minlength=part.num_rows)
    digest = np.zeros(part.num_rows, np.uint64)
    np.add.at(digest, owner, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
    return h, owner, n, mix(digest + n.astype(np.uint64)).astype(np.int64)


def _pack48(h: np.ndarray) -> bytes:
    return h.astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class (of equal sets; null if empty) and n (size of the set) per row."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                _, _, n, ids = _sets(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(ids, mask=n == 0), pa.array(n)], names=["doc_id", "text_key", "class", "n"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, class long, n long")


#: Shingles of many classes, column-wise, in rows by (deal, bucket): the classes, their sizes and how many shingles of each follow.
_DEALT = pa.schema([("deal", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "sizes", "counts", "low", "high", "ranks"))])
_DEALT_SQL = "deal int, bucket int, ids binary, sizes binary, counts binary, low binary, high binary, ranks binary"


def _dealt(deal, bucket, ids, n, owner, h, rank) -> pa.RecordBatch:
    """Rows of _DEALT: deal, owner, h and rank (or None) by shingle, those of a class together; bucket: one for all, or None for deal."""
    order = np.argsort(deal, kind="stable")
    edges = np.flatnonzero(np.diff(deal[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
    rows = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[x:y]
        own, to = owner[at], int(deal[at[0]])
        new = np.flatnonzero(np.diff(own, prepend=-1))
        held = own[new]
        rows.append((to, to if bucket is None else bucket, ids[held].tobytes(), n[held].astype("<u4").tobytes(), np.diff(np.append(new, len(at))).astype("<u4").tobytes(), h[at].astype("<u4").tobytes(), (h[at] >> np.uint64(32)).astype(np.uint8).tobytes(), b"" if rank is None else rank[at].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _DEALT.types, strict=True)], schema=_DEALT)


def _read(table: pa.Table):
    """Classes, sizes, each shingle's class by number, the shingles (40 bits) and their ranks."""
    col = {c: b"".join(table.column(c).to_pylist()) for c in _DEALT.names[2:]}
    ids, n = np.frombuffer(col["ids"], np.int64), np.frombuffer(col["sizes"], "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), np.frombuffer(col["counts"], "<u4"))
    h = np.frombuffer(col["low"], "<u4").astype(np.uint64) | np.frombuffer(col["high"], np.uint8).astype(np.uint64) << np.uint64(32)
    return ids, n, owner, h, np.frombuffer(col["ranks"], np.uint8)


def prefix(n):
    """Length of the prefix in which two sets over the threshold share a shingle."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def listed(docs: DataFrame) -> DataFrame:
    """class, n, home, keys: what classes list, of those whose prefix isn't filled by shingles of their own.

    A shingle's key is its bucket and 40 bits of its hash. docs: as near_duplicates() has them.
    """
    parts = n_partitions(docs.sparkSession)
    buckets = 3 * parts

    def deal(batches):
        for batch in batches:
            for part in chunks(batch):
                h, owner, n, ids = _sets(part)
                once = np.zeros(len(ids), bool)
                once[np.unique(ids, return_index=True)[1]] = True
                h, owner = h[once[owner]], owner[once[owner]]
                yield _dealt(((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32), None, ids, n, owner, h, None)

    def shared(table: pa.Table) -> pa.Table:
        """The bucket's shingles of two classes or more, dealt by class."""
        ids, n, owner, h, _ = _read(table)
        once = np.zeros(len(ids), bool)  # classes are told in every partition that has a copy
        once[np.unique(ids, return_index=True)[1]] = True
        owner, h = owner[once[owner]], h[once[owner]]
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
        size = np.diff(np.append(begin, len(h)))
        rank = np.empty(len(h), np.uint8)
        rank[order] = np.repeat(np.log2(size).astype(np.uint8), size)
        owner, h, rank = owner[rank > 0], h[rank > 0], rank[rank > 0]
        home = ((mix(ids.view(np.uint64)) >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int32)
        return pa.Table.from_batches([_dealt(home[owner], table.column("bucket")[0].as_py(), ids, n, owner, h, rank)])

    def take(table: pa.Table) -> pa.Table:
        """Classes with all their shared shingles: those that list some."""
        ids, n, owner, h, rank = _read(table)
        held = [len(x) // 4 for x in table.column("low").to_pylist()]
        key = np.repeat(table.column("bucket").to_numpy().astype(np.uint64), held) << np.uint64(40) | h
        ids, first, by = np.unique(ids, return_index=True, return_inverse=True)
        n, owner = n[first], by[owner]
        room = prefix(n) - (n - np.bincount(owner, minlength=len(ids)))
        keep = room[owner] > 0
        owner, key, rank = owner[keep], key[keep], rank[keep]
        order = np.lexsort((key, rank, owner))
        owner, key, rank = owner[order], key[order], rank[order]
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        keep = place < room[owner]
        owner, key, rank = owner[keep], key[keep], rank[keep]
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        most = np.lexsort((key, -rank.astype(np.int16), owner))[begin]
        at = pa.array(np.append(begin, len(owner)), pa.int32())
        return pa.Table.from_arrays([pa.array(ids[owner[begin]]), pa.array(n[owner[begin]]), pa.array(key[most].view(np.int64)), pa.ListArray.from_arrays(at, pa.array(key.view(np.int64)))], names=["class", "n", "home", "keys"])

    met = docs.select("text").mapInArrow(deal, _DEALT_SQL).groupBy("deal").applyInArrow(shared, _DEALT_SQL)
    return met.groupBy("deal").applyInArrow(take, "class long, n long, home long, keys array<long>")


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, hashes (its set, 48 bits each), point (its counts by group) of classes (class, row_id, text_key)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                h, owner = shingles(*text_bytes(part.column("text")))
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
                points = np.bincount(owner * GROUPS + (h >> np.uint64(41)).astype(np.int64), minlength=part.num_rows * GROUPS).astype("<u4").reshape(-1, GROUPS)
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array([_pack48(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([p.tobytes() for p in points], pa.binary())], names=["class", "hashes", "point"])

    found = docs.join(classes, ["row_id", "text_key"]).select("class", "text").mapInArrow(run, "class long, hashes binary, point binary")
    return found.groupBy("class").agg(F.first("hashes").alias("hashes"), F.first("point").alias("point"))  # a repeated row is one


def reaches(overlap, n, m):
    """Whether an overlap of sets of n and m gives a Jaccard similarity over the threshold."""
    return (NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (n + m)


class CountTree:
    """Points (counts by group, of sets of n shingles) under nodes of bounding maxima; members are split at the median of the widest of size and group counts."""

    def __init__(self, points: np.ndarray, n: np.ndarray, label: np.ndarray, members: np.ndarray, leaf: int = LEAF):
        self.points, self.n, self.label = points, n, label
        self.top = self._node(members, leaf)

    def _node(self, members: np.ndarray, leaf: int):
        p, size, one = self.points[members], self.n[members], self.label[members]
        node = {"hi": p.max(0), "least": size.min(), "most": size.max(), "label": one[0] if (one == one[0]).all() else None}
        if len(members) <= leaf:
            return node | {"members": members}
        spread = p.max(0) - p.min(0)
        by = size if size.max() - size.min() >= 8 * spread.max() else p[:, int(spread.argmax())]
        order = np.argsort(by, kind="stable")
        half = len(members) // 2
        return node | {"parts": (self._node(members[order[:half]], leaf), self._node(members[order[half:]], leaf))}

    def pairs(self, other: CountTree):
        """(members, members) of the leaf pairs that may hold a pair over the threshold of two labels; other may be this tree itself."""
        todo = [(self.top, other.top)]
        while todo:
            a, b = todo.pop()
            if a["label"] is not None and a["label"] == b["label"]:
                continue
            if a is not b:
                if DENOMINATOR * min(a["most"], b["most"]) < NUMERATOR * max(a["least"], b["least"]):
                    continue
                if not reaches(np.minimum(a["hi"], b["hi"]).sum(), a["least"], b["least"]):
                    continue
            if "members" in a and "members" in b:
                yield a["members"], b["members"]
            elif a is b:
                x, y = a["parts"]
                todo += [(x, x), (x, y), (y, y)]
            elif "members" in a or "parts" in b and b["most"] > a["most"]:
                todo += [(a, x) for x in b["parts"]]
            else:
                todo += [(x, b) for x in a["parts"]]


def _overlaps(col: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact overlaps of members p with members q, from each one's shingles as numbers (col, in places at)."""

    def side(members):
        lens = at[members + 1] - at[members]
        place = np.repeat(at[members] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return col[place], np.repeat(np.arange(len(members)), lens)

    (a, i), (b, j) = side(p), side(q)
    both, out = np.intersect1d(a, b), np.zeros((len(p), len(q)), np.int64)

    def dense(c, row, rows, part):
        place = np.minimum(np.searchsorted(part, c), len(part) - 1)
        hit = part[place] == c
        m = np.zeros((rows, len(part)), np.float32)
        m[row[hit], place[hit]] = 1
        return m

    for x in range(0, len(both), _COLUMNS):
        part = both[x : x + _COLUMNS]
        out += (dense(a, i, len(p), part) @ dense(b, j, len(q), part).T).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], points: np.ndarray, label: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets of two labels that are over the threshold; with sides, only of two sides."""
    n, m = np.array([len(s) for s in sets]), np.arange(len(sets))
    h, owner = np.concatenate(sets), np.repeat(m, n)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    often = np.append(False, ~new[1:]) | np.append(~new[1:], False)  # in more than one set
    row, col = owner[order][often], (np.cumsum(new) - 1)[often]
    order = np.argsort(row, kind="stable")
    col, at = col[order], np.searchsorted(row[order], np.arange(len(sets) + 1))
    if side is None:
        tree = CountTree(points, n, label, m)
        near = tree.pairs(tree)
    else:
        near = CountTree(points, n, label, m[side == 0]).pairs(CountTree(points, n, label, m[side == 1]))
    found = [(m[:0], m[:0])]
    for p, q in near:
        x, y = n[p][:, None], n[q][None, :]
        ok = (label[p][:, None] != label[q][None, :]) & (DENOMINATOR * np.minimum(x, y) >= NUMERATOR * np.maximum(x, y))
        ok &= reaches(np.minimum(points[p][:, None, :], points[q][None, :, :]).sum(2), x, y)
        if p is q:
            ok &= p[:, None] < q[None, :]
        if ok.any():
            i, j = np.nonzero(ok & reaches(_overlaps(col, at, p, q), x, y))
            found.append((p[i], q[j]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _star(table: pa.Table, priority: np.ndarray, label: np.ndarray, side: np.ndarray | None = None) -> pa.Table:
    """a, b: a spanning star of the links in one block or pair of blocks, around the members of the least priority."""
    order = np.argsort(priority, kind="stable")
    ids = table.column("class").to_numpy()[order]
    hashes, points = table.column("hashes").to_pylist(), table.column("point").to_pylist()
    sets = [_unpack48(hashes[i]) for i in order.tolist()]
    points = np.array([np.frombuffer(points[i], "<u4") for i in order.tolist()]).astype(np.int64)
    i, j = linked(sets, points, label[order], None if side is None else side[order])
    node, root = roots(i, j)
    return pa.Table.from_arrays([pa.array(ids[node[node != root]]), pa.array(ids[root[node != root]])], names=["a", "b"])


def _slots(count: str, shingles_: str):
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles_) / BLOCK_SHINGLES), F.lit(1).cast("long"))


def _place(column: str, slots: str):
    return F.pmod(F.xxhash64(column), F.col(slots))


def _homes(classes: DataFrame) -> DataFrame:
    """home, slots (blocks that it needs) and leaders of every home."""
    leaders = [F.min_by("class", F.xxhash64("class", F.lit(i))) for i in range(LEADERS)]
    got = classes.groupBy("home").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.array_distinct(F.array(*leaders)).alias("leaders"))
    return got.withColumn("slots", _slots("c", "w"))


def links_at_home(classes: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: spanning stars of the links within each block of a home, each block with the home's leaders."""
    more = homes.where("c > 1")
    own = classes.join(more.select("home", "slots"), "home").select("class", "home", _place("class", "slots").alias("slot"), F.lit(False).alias("lead"))
    lead = more.where("slots > 1").select(F.explode("leaders").alias("class"), "home", "slots").select("class", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.lit(True).alias("lead"))
    seats = own.unionByName(lead).groupBy("class", "home", "slot").agg(F.max("lead").alias("lead"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        return _star(table, np.lexsort((ids, ~table.column("lead").to_numpy())).argsort(), np.arange(len(ids)))

    return seats.join(sets, "class").groupBy("home", "slot").applyInArrow(run, "a long, b long")


def labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with label: equal for some of what the stars have joined, never for what they haven't."""
    up = links.groupBy("a").agg(F.min("b").alias("b"))
    two = up.join(up.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", "left").select(F.col("a").alias("class"), F.coalesce("top", "b").alias("label"))
    return classes.join(two, "class", "left").withColumn("label", F.coalesce("label", "class"))


def blocks_apart(classes: DataFrame, homes: DataFrame) -> DataFrame:
    """classes (with label) and their block: a home's large labels have blocks of their own, the others share some."""
    per = classes.groupBy("home", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w")).withColumn("own", F.col("c") >= BLOCK).withColumn("own_slots", _slots("c", "w"))
    pools = per.where("not own").groupBy("home").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).select("home", _slots("c", "w").alias("pool_slots"))
    got = classes.join(per.select("home", "label", "own", "own_slots"), ["home", "label"]).join(pools, "home", "left").join(homes.select("home", (F.col("slots") == 1).alias("done")), "home")
    block = F.when(F.col("own"), F.xxhash64("home", "label", _place("class", "own_slots"))).otherwise(F.xxhash64("home", _place("label", "pool_slots")))
    return got.select("class", "n", "home", "label", "done", block.alias("block"))


def links_between(classes: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: spanning stars of the links between labels in pairs of blocks that list a common shingle. keys: class, keys."""

    def bound(table: pa.Table) -> pa.Table:
        points = np.array([np.frombuffer(p, "<u4") for p in table.column("point").to_pylist()])
        return pa.Table.from_arrays([table.column("block")[:1], pa.array([points.max(0).astype(np.int64)], pa.list_(pa.int64()))], names=["block", "hi"])

    about = classes.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("one"), F.first("home").alias("home"), F.first("done").alias("done"))
    member = classes.select("class", "block")
    met = keys.select("class", F.explode("keys").alias("key")).join(member, "class").groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("met")).where("size(met) > 1").select("met").distinct()
    cross = met.selectExpr("met", "posexplode(met) as (i, x)").selectExpr("x", "explode(slice(met, i + 2, size(met))) as y").distinct()
    side = lambda s: about.select(*[F.col(c).alias(f"{s}_{c}" if c != "block" else s) for c in about.columns])
    cross = cross.join(side("x"), "x").join(side("y"), "y")
    cross = cross.where("not (x_one and y_one and x_label = y_label) and not (x_done and y_done and x_home = y_home)")
    cross = written(cross.where(f"{DENOMINATOR} * least(x_most, y_most) >= {NUMERATOR} * greatest(x_least, y_least)").select("x", "y", "x_least", "y_least"), "block-pairs")
    used = cross.select(F.explode(F.array("x", "y")).alias("block")).distinct()
    highs = written(member.join(used, "block").join(sets.select("class", "point"), "class").groupBy("block").applyInArrow(bound, "block long, hi array<long>"), "bounds")
    near = cross.join(highs.select(F.col("block").alias("x"), F.col("hi").alias("x_hi")), "x").join(highs.select(F.col("block").alias("y"), F.col("hi").alias("y_hi")), "y")
    near = near.where(f"{NUMERATOR + DENOMINATOR} * aggregate(zip_with(x_hi, y_hi, (p, q) -> least(p, q)), 0L, (s, p) -> s + p) >= {NUMERATOR} * (x_least + y_least)").select("x", "y")
    alone = about.where("not one and not done").select(F.col("block").alias("x"), F.col("block").alias("y"))
    seats = near.unionByName(alone).selectExpr("x", "y", "inline(if(x = y, array(named_struct('block', x, 'side', 0)), array(named_struct('block', x, 'side', 0), named_struct('block', y, 'side', 1))))")
    seats = seats.join(classes.select("class", "block", "label"), "block").select("x", "y", "side", "class", "label")

    def run(table: pa.Table) -> pa.Table:
        labels, sides = table.column("label").to_numpy(), table.column("side").to_numpy()
        return _star(table, table.column("class").to_numpy(), labels, sides if sides.any() else None)

    return seats.join(sets, "class").groupBy("x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class (equal sets), n_shingles, component_id and group (a component's number, null if empty) per row."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch(spark):
        rows = written(sized(own), "rows", lasting=True)
        classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("row_id"), "text_key")).alias("r"))
        lists = written(listed(own), "listed")
        sets = written(whole_sets(own, lists.select("class").join(classes, "class").select("class", "r.*")), "sets")
        plain = lists.select("class", "n", "home")
        homes = written(_homes(plain), "homes")
        links = written(links_at_home(plain, homes, sets), "links-home")
        apart = written(blocks_apart(labelled(plain, links), homes), "blocks")
        links = links.unionByName(written(links_between(apart, lists.select("class", "keys"), sets), "links-between"))
        labels = components(links).withColumnsRenamed({"node": "class", "label": "group"})
        held = classes.select("class", "least").join(labels, "class", "left").withColumn("group", F.coalesce("group", "class"))
        first = held.groupBy("group").agg(F.min("least").alias("component_id"))
        held = written(held.join(first, "group").select("class", "component_id", "group"), "components", lasting=True)
    return rows.join(held, "class", "left").select("doc_id", "text_key", "class", F.col("n").alias("n_shingles"), "group", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id (null last), then of the smallest text key.

    Empty texts stay, each of them; of rows that repeat both doc_id and text one stays.
    """
    key = [F.col("doc_id").isNull().alias("k_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id")]
    found = near_duplicates(docs).where("group is not null").groupBy(*key, "text_key", "group").agg(F.count("*").alias("k_rows"))
    kept = found.groupBy("group").agg(F.min(F.struct("k_none", "k_id", "text_key")).alias("kept"))
    mark = found.join(kept, "group").select("k_none", "k_id", F.col("text_key").alias("k_text"), "k_rows", (F.col("kept") == F.struct("k_none", "k_id", "text_key")).alias("k_first"))
    mark = written(mark.where("not k_first or k_rows > 1").select("k_none", "k_id", "k_text", "k_first"), "other-rows")
    own = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)], *key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_text"))
    keys = ["k_none", "k_id", "k_text"]
    marked, others = split_by_keys(own, mark, keys)
    once = marked.join(mark.where("k_first").select(keys), keys).dropDuplicates(keys)  # repeated rows alone
    got = others.unionByName(marked.join(mark.select(keys), keys, "left_anti")).unionByName(once)
    return got.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
