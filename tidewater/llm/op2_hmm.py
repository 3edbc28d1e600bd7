"""Hidden Markov language model over words, trained by Baum-Welch on all training documents.

Word counts of the training documents are gathered in buckets of the word's hash. The `HEAD` most frequent words (ties left
out) are symbols of their own; other words are one tail symbol times their smoothed share of the tail, so every text has an
exact probability. Each partition runs scaled forward-backward recursions over its documents, many at a time, and gives
expected counts; their sums give the next model. `ROUNDS` rounds from a fixed start run over all of them, in single precision. A text's score is the scaled forward recursion's
likelihood in double precision, in log10, over the words and one end; texts are taken whole, however long.

Only head words' hashes and counts (HEAD of them) and the model are sent to the executors; words of the tail meet their
counts in a shuffle. Null texts are empty (one end). A row without doc_id is a training row. Repeated rows count each for
itself; other columns are ignored; an empty table gives no rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, mix, n_partitions, noise, shuffles_cleaned, text_bytes, words, written

HEAD, STATES = 60_000, 8
ROUNDS, PRIOR = 14, 30.0
_TOKENS = 1 << 20
_SLICES = 16
_MERGE = 2_000_000


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)


def _split(bucket: np.ndarray):
    """(bucket, indices) of each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(h, return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """bucket, hashes, counts: every word of the texts, packed by bucket of its hash."""
    buckets = 2 * n_partitions(docs.sparkSession)

    def count(batches):
        held, size = [], 0

        def out():
            h, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows = [(b, h[at].tobytes(), n[at].tobytes()) for b, at in _split(_bucket(h, buckets))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "hashes", "counts"])

        for batch in batches:
            for part in chunks(batch):
                h = words(*text_bytes(part.column("text")), lower=True)[0]
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size > _MERGE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("counts", np.int64)))
        h, n = _summed(h, n)
        return pa.Table.from_pylist([{"bucket": table.column("bucket")[0].as_py(), "hashes": h.tobytes(), "counts": n.tobytes()}], schema=pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    packed = "bucket int, hashes binary, counts binary"
    return docs.select("text").mapInArrow(count, packed).groupBy("bucket").applyInArrow(add, packed)


@dataclass
class Vocabulary:
    head: np.ndarray  # hashes, ascending
    counts: np.ndarray
    tokens: int  # N: words and ends
    types: int  # V: distinct, with the end
    docs: int
    tail_tokens: int
    tail_types: int

    @property
    def tail(self) -> int:
        return len(self.head)

    @property
    def end(self) -> int:
        return len(self.head) + 1

    def shares(self) -> np.ndarray:
        """Unigram probabilities of the symbols: head, tail, end; each above 0."""
        n = np.concatenate([self.counts, [self.tail_tokens + 1, self.docs + 1]]).astype(float)
        return n / n.sum()


def vocabulary(counts: DataFrame, n_docs: int, head: int = HEAD) -> Vocabulary:
    """The head is every word above the count that no more than `head` words reach."""

    def tally(batches):
        for batch in batches:
            n = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(n, return_counts=True)], names=["c", "types"])

    tallied = counts.select("counts").mapInArrow(tally, "c long, types long").groupBy("c").agg(F.sum("types").alias("types")).toArrow().sort_by([("c", "descending")])
    c, types = tallied.column("c").to_numpy(), tallied.column("types").to_numpy()
    fits = int(np.searchsorted(np.cumsum(types), head, side="right"))
    least = int(c[fits - 1]) if fits else 1 << 62

    def take(batches):
        for batch in batches:
            h, n = (np.frombuffer(b"".join(batch.column(k).to_pylist()), t) for k, t in (("hashes", np.int64), ("counts", np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(h[n >= least]), pa.array(n[n >= least])], names=["h", "n"])

    got = counts.select("hashes", "counts").mapInArrow(take, "h long, n long").toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    total, kinds = int((c * types).sum()), int(types.sum())
    return Vocabulary(h[order], n[order], total + n_docs, kinds + bool(n_docs), n_docs, total - int(n.sum()), kinds - len(n))


def coded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs (row_id, doc_id, held_out, text) as symbols: ids (16 bits each, with the end), tail (hashes), n_tokens, head_log (sum of log10(c + 1) over head and end)."""
    logs = np.log10(np.append(v.counts, [0, v.docs]) + 1.0)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                h, _, _, at = words(*text_bytes(part.column("text")), lower=True)
                ids = np.full(len(h), v.tail)
                if v.tail:
                    i = np.minimum(np.searchsorted(v.head, h), v.tail - 1)
                    ids = np.where(v.head[i] == h, i, v.tail)
                rare = ids == v.tail
                before = np.append(0, np.cumsum(rare))[at]
                tails = h[rare]
                sums = np.bincount(np.repeat(np.arange(part.num_rows), np.diff(at)), weights=logs[ids], minlength=part.num_rows)
                full = np.insert(ids, at[1:], v.end).astype(np.uint16)
                ends = at + np.arange(len(at))
                cut = [(full[a:b].tobytes(), tails[x:y].tobytes()) for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), before[:-1].tolist(), before[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), part.column("doc_id"), part.column("held_out"), pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary()), pa.array(np.diff(at) + 1), pa.array(sums + logs[v.end])],
                    names=["row_id", "doc_id", "held_out", "ids", "tail", "n_tokens", "head_log"],
                )

    return docs.mapInArrow(run, "row_id long, doc_id long, held_out boolean, ids binary, tail binary, n_tokens long, head_log double")


def tail_logs(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row_id, tail_log (sum of log10(c + 1) over its tail words), tail_known (those with c > 0), packed on both ways."""
    buckets, parts = 2 * n_partitions(rows.sparkSession), n_partitions(rows.sparkSession)

    def deal(batches):
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            lists = [np.frombuffer(x, np.uint64) for x in batch.column("tail").to_pylist()]
            h = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            owner = np.repeat(ids, [len(x) for x in lists])
            made = [(b, h[at].tobytes(), owner[at].tobytes(), False) for b, at in _split(_bucket(h, buckets))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.bool_()), strict=True)], names=["bucket", "hashes", "numbers", "known"])

    def look_up(table: pa.Table) -> pa.Table:
        def side(known: bool):
            part = table.filter(pa.compute.equal(table.column("known"), known))
            return (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("numbers", np.int64)))

        keys, n = side(True)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        h, owner = side(False)
        c = np.zeros(len(h), np.int64)
        if len(keys):
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            c = np.where(keys[i] == h, n[i], 0)
        rows_, at = np.unique(owner, return_inverse=True)
        logs, seen = np.bincount(at, weights=np.log10(c + 1.0), minlength=len(rows_)), np.bincount(at, weights=c > 0, minlength=len(rows_)).astype(np.int64)
        home = _bucket(rows_.view(np.uint64), parts)
        out = [(b, rows_[x].tobytes(), logs[x].tobytes(), seen[x].tobytes()) for b, x in _split(home)]
        return pa.Table.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["home", "rows", "logs", "seen"])

    def gather(table: pa.Table) -> pa.Table:
        ids, logs, seen = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rows", np.int64), ("logs", np.float64), ("seen", np.int64)))
        order = np.lexsort((logs, ids))  # sums don't depend on the order of arrival
        keys, at = np.unique(ids[order], return_inverse=True)
        return pa.Table.from_arrays([pa.array(keys), pa.array(np.bincount(at, weights=logs[order])), pa.array(np.bincount(at, weights=seen[order]).astype(np.int64))], names=["row_id", "tail_log", "tail_known"])

    kind = "bucket int, hashes binary, numbers binary, known boolean"
    both = rows.select("row_id", "tail").mapInArrow(deal, kind).unionByName(counts.select("bucket", "hashes", F.col("counts").alias("numbers"), F.lit(True).alias("known")))
    back = both.groupBy("bucket").applyInArrow(look_up, "home int, rows binary, logs binary, seen binary")
    return back.groupBy("home").applyInArrow(gather, "row_id long, tail_log double, tail_known long")


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    def single(self) -> Model:
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


def first_model(shares: np.ndarray, states: int = STATES) -> Model:
    """Sticky states whose emissions are the unigram shares, each word leaning to a state by fixed noise."""
    lean = 0.2 + (noise(len(shares) * states, 51) >> np.uint64(11)).reshape(len(shares), states) / 2.0**53
    emit = shares[:, None] * lean
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) * (1 - np.eye(states)) + 0.9 * np.eye(states), emit / emit.sum(0))


def _time_major(lists: list[np.ndarray]):
    """Sequences, longest first, laid out step by step: symbols, sequences alive and offset at each step."""
    lens = np.array([len(x) for x in lists])
    alive = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
    offset = np.append(0, np.cumsum(alive))
    flat = np.empty(int(lens.sum()), np.int64)
    for i, x in enumerate(lists):
        flat[offset[: len(x)] + i] = x
    return flat, alive, offset


def recursion(m: Model, lists: list[np.ndarray]):
    """Scaled forward recursion of sequences, longest first: symbols, alive, offset, emissions, states' shares and scales."""
    flat, alive, offset = _time_major(lists)
    e = m.emit.take(flat, axis=0, mode="clip")
    a, c, ones, before = np.empty_like(e), np.empty(len(flat), e.dtype), np.ones(len(m.start), e.dtype), None
    for i, k in zip(offset.tolist(), alive.tolist(), strict=False):
        x, s = a[i : i + k], c[i : i + k]
        if before is None:
            x[:] = m.start
        else:
            np.matmul(before[:k], m.move, out=x)
        x *= e[i : i + k]
        np.matmul(x, ones, out=s)
        x /= s[:, None]
        before = x
    return flat, alive, offset, e, a, c


def forward(m: Model, lists: list[np.ndarray]):
    """Natural log-likelihoods of sequences, longest first, and what `expected` needs."""
    run = recursion(m, lists)
    flat, alive, offset, *_, c = run
    owner = np.arange(len(flat)) - np.repeat(offset[:-1], alive)
    return np.bincount(owner, weights=np.log(c, dtype=float), minlength=len(lists)), run


def expected(m: Model, run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and (by symbol) emissions, by the scaled backward recursion."""
    flat, alive, offset, e, a, c = run
    states, back = len(m.start), np.ascontiguousarray(m.move.T)
    later, move = np.ones((int(alive[0]), states), e.dtype), np.zeros((states, states))
    at, n = offset.tolist(), alive.tolist()
    for t in range(len(n) - 1, 0, -1):  # `later` of sequences that end at a step is still 1 there
        i, j, k = at[t - 1], at[t], n[t]
        a[j : j + k] *= later[:k]
        ahead = e[j : j + k]
        ahead *= later[:k] / c[j : j + k, None]
        move += a[i : i + k].T @ ahead
        np.matmul(ahead, back, out=later[:k])
    k = n[0]
    a[:k] *= later
    start = a[:k].sum(0)
    return start, move * m.move, np.stack([np.bincount(flat, weights=w, minlength=len(m.emit)) for w in a.T], 1)


def _groups(lists: list[np.ndarray]):
    """Indices of sequences, longest first, in groups of about _TOKENS symbols."""
    order, held, size = sorted(range(len(lists)), key=lambda i: -len(lists[i])), [], 0
    for i in order:
        held.append(i)
        size += len(lists[i])
        if size >= _TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def baum_welch(rows: DataFrame, m: Model, shares: np.ndarray) -> Model:
    """One round over the rows' ids: partitions' expected counts, summed by slice of the symbols.

    Recursions run in single precision and their counts are summed in double: a step's values are shares of one, which
    smoothing keeps above about (states / tokens)**2, so that neither they nor their inverses leave its range.
    """
    states = len(m.start)

    def run(batches):
        lean = m.single()
        total = np.zeros((len(shares), states))
        start, move = np.zeros(states), np.zeros((states, states))
        for batch in batches:
            lists = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
            for group in _groups(lists):
                got = expected(lean, recursion(lean, [lists[i] for i in group]))
                start += got[0]
                move += got[1]
                total += got[2]
        parts = [*np.array_split(total, _SLICES), np.vstack([start, move])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES + 1, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "sums"])

    def add(table: pa.Table) -> pa.Table:
        rows_ = sorted(table.column("sums").to_pylist())
        sums = np.zeros(len(rows_[0]) // 8)
        for x in rows_:
            sums += np.frombuffer(x)
        return pa.Table.from_pylist([{"slice": table.column("slice")[0].as_py(), "sums": sums.tobytes()}], schema=pa.schema([("slice", pa.int32()), ("sums", pa.binary())]))

    got = rows.select("ids").mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()
    if not got:
        return m
    by = {r["slice"]: np.frombuffer(r["sums"]).reshape(-1, states) for r in got}
    emit, ends = np.concatenate([by[i] for i in range(_SLICES)]), by[_SLICES]
    emit = emit + PRIOR * shares[:, None]
    start, move = ends[0] + 1 / states, ends[1:] + 1 / states
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(rows: DataFrame, v: Vocabulary) -> Model:
    """ROUNDS rounds over all rows, whatever their number; a round's shuffle files go when its sums are there."""
    shares = v.shares()
    m = first_model(shares)
    with shuffles_cleaned(rows.sparkSession):
        for _ in range(ROUNDS):
            m = baum_welch(rows, m, shares)
    return m


def scored(rows: DataFrame, m: Model) -> DataFrame:
    """rows with forward_log10, without ids and tail."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
            out = np.zeros(len(lists))
            for group in _groups(lists):
                out[group] = forward(m, [lists[i] for i in group])[0] / np.log(10)
            kept = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out)], names=[*kept.schema.names, "forward_log10"])

    return rows.select("row_id", "doc_id", "held_out", "n_tokens", "head_log", F.expr("length(tail) div 8").alias("n_tail"), "ids").mapInArrow(run, "row_id long, doc_id long, held_out boolean, n_tokens long, head_log double, n_tail long, forward_log10 double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").withColumn("row_id", F.monotonically_increasing_id())
    n_train = own.where("not held_out").count()
    counts = written(word_counts(own.where("not held_out")), "word-counts")
    v = vocabulary(counts, n_train)
    rows = written(coded(own.select("row_id", "doc_id", "held_out", "text"), v), "coded")
    m = train(rows.where("not held_out"), v)
    got = scored(rows, m).join(tail_logs(rows, counts), "row_id", "left")
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    ends = 1 if n_train else 0
    known = F.col("n_tokens") - 1 - F.col("n_tail") + tail_known + ends
    base = F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(float(np.log10(v.tokens + v.types + 1)))
    score = F.col("forward_log10") + tail_log - F.col("n_tail") * F.lit(float(np.log10(v.tail_tokens + v.tail_types + 1)))
    return got.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(documents(spark, sf_dir))
