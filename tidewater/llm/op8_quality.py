"""Quality by pairwise preference: a Bradley-Terry model of document scores.

Every pair of a good and a bad labelled document says that the first is preferred. A linear score of text features is
learnt by logistic loss on the pair's difference of features; the acceptance threshold is the quantile of scores that
leaves out as many as the labels do. Features come from the text alone: hashed byte pairs, character classes, word and
line statistics.

`fit` learns from every labelled document and from all pairs of a good and a bad one, by Newton steps on their mean loss.
Pairs aren't listed: what one document's pairs add depends on its score alone, by a sum over the other class's scores,
which are counted on a grid of 256 nodes a unit, each dealt to the two nodes beside it (a pair's preference is right to
4e-7). A step is two passes over a table of features; the driver gets counts by node and sums of fixed size. The threshold
lies between two exact ranks of all labelled documents' scores. Sums of doubles come in any order, so that weights are the
same from run to run to about 9 digits. `rank` is the same model in memory by random batches of pairs; no query uses it.

Scoring covers every row and every whole text. Null texts are empty. Repeated label rows of a document count once, by their
largest value; null labels and those other than 0 and 1 don't count; of rows that repeat a doc_id, one is learnt from, that
with the least features as bytes. Without documents of both classes every score is 0.5. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, mix, noise, scratch, split_by_keys, text_bytes, windows, words, written

PAIRS, STEPS, RATE, DECAY = 6000, 250, 0.05, 1e-3
ACCEPT = 0.7
_PAIR_BINS = 256
_CLASSES = (range(97, 123), range(65, 91), range(48, 58), (10,), (32,), (44, 46), (33, 63), (35, 36, 37, 38, 42), (124, 60, 62, 123, 125, 91, 93, 95, 47, 92, 94, 126, 64), range(0x80, 256))
N_FEATURES = _PAIR_BINS + len(_CLASSES) + 6
_PAIR_KIND = (noise(1 << 16, 41) % np.uint64(_PAIR_BINS)).astype(np.uint8)
#: Bytes of text whose features are worked out at once; they take some 45 times as much memory.
_AT_ONCE = 1 << 19
#: Nodes a unit of score, for losses and slopes; scores beyond _MOST count as that.
_GRID, _MOST = 256, 500
#: Nodes for the curvature, which only steers the steps, between scores of -_REACH and _REACH.
_COARSE, _REACH = 2, 32
_NODES = 2 * _COARSE * _REACH + 1
#: Rows of features at once; tasks of a pass, and parts that their sums are added up in.
_ROWS, _TASKS, _PARTS = 1024, 64, 64


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of N_FEATURES for concatenated UTF-8 texts."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)[:, None]
    out = np.zeros((n, N_FEATURES))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    if len(buf) > 1:
        pair = _PAIR_KIND[buf[:-1].astype(np.uint16) << 8 | buf[1:]]
        inside = owner[:-1] == owner[1:]
        out[:, :_PAIR_BINS] = np.bincount((owner[:-1] * _PAIR_BINS + pair)[inside], minlength=n * _PAIR_BINS).reshape(n, -1) / size
    table = np.full(256, len(_CLASSES))
    for i, members in enumerate(_CLASSES):
        table[list(members)] = i
    width = len(_CLASSES) + 1
    out[:, _PAIR_BINS : _PAIR_BINS + width - 1] = np.bincount(owner * width + table[buf], minlength=n * width).reshape(n, -1)[:, :-1] / size
    out[:, : _PAIR_BINS + width - 1] = np.log1p(1000 * out[:, : _PAIR_BINS + width - 1])
    h, starts, ends, at = words(buf, offsets, lower=True)
    count = np.maximum(np.diff(at), 1)
    by = np.repeat(np.arange(n), np.diff(at))

    def distinct(values, own):
        first = np.unique(mix(values + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        return np.bincount(own[first], minlength=n)

    gram = windows(h, 3)
    own = by[: len(gram)] if len(gram) else by[:0]
    whole = own == by[2:] if len(gram) else own.astype(bool)
    grams = np.bincount(own[whole], minlength=n)
    letters = np.bincount(by, weights=ends - starts, minlength=n) / count
    spread = np.sqrt(np.maximum(0, np.bincount(by, weights=(ends - starts) ** 2.0, minlength=n) / count - letters**2))
    out[:, -6:] = np.stack([np.log1p(count), distinct(h, by) / count, distinct(gram[whole], own[whole]) / np.maximum(grams, 1), np.log1p(letters), np.log1p(spread), np.log1p(size[:, 0])], 1)
    return out


@dataclass
class Ranking:
    """score = sigmoid(weights . (features - mean) / scale - threshold + logit(ACCEPT))."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        raw = ((x - self.mean) / self.scale) @ self.weights - self.threshold + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def rank(good: np.ndarray, bad: np.ndarray, share_bad: float, seed: int = 7) -> Ranking:
    """Learns from all good-bad preferences by batches of random pairs."""
    if not len(good) or not len(bad):
        return Ranking(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1
    good, bad = (good - mean) / scale, (bad - mean) / scale
    rng, w = np.random.default_rng(seed), np.zeros(N_FEATURES)
    m = v = np.zeros(N_FEATURES)
    for step in range(1, STEPS + 1):
        d = good[rng.integers(len(good), size=PAIRS)] - bad[rng.integers(len(bad), size=PAIRS)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -500, 500)))[:, None]).mean(0) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    got = np.concatenate([good @ w, bad @ w])
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(got)
    below = np.cumsum(weight[order])
    i = min(int(np.searchsorted(below, share_bad)), len(got) - 2)
    return Ranking(w, mean, scale, float((got[order][i] + got[order][i + 1]) / 2))


def _rows(batches):
    """Labels and features of the next rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part.column("quality").to_numpy(), np.frombuffer(b"".join(part.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _dealt(s: np.ndarray, most: float, per_unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The node below each score, counted from that of -most, and the share of the node above."""
    at = (np.clip(s, -most, most) + most) * per_unit
    node = np.minimum(at.astype(np.int64), 2 * most * per_unit - 1)
    return node, at - node


def _merged(a, b):
    """Rows of each class, mean and squared deviations of two sets of rows."""
    n, m, d = a[0].sum(), b[0].sum(), b[1] - a[1]
    return a[0] + b[0], a[1] + d * (m / max(n + m, 1)), a[2] + b[2] + d * d * (n * m / max(n + m, 1))


def _moments(table: DataFrame):
    none = np.zeros(2, np.int64), np.zeros(N_FEATURES), np.zeros(N_FEATURES)

    def run(batches):
        held = none
        for y, x in _rows(batches):
            held = _merged(held, (np.bincount(y, minlength=2), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in held], names=["n", "mean", "squares"])

    held = none
    for row in sorted(table.mapInArrow(run, "n binary, mean binary, squares binary").collect()):
        held = _merged(held, (np.frombuffer(row["n"], np.int64), np.frombuffer(row["mean"]), np.frombuffer(row["squares"])))
    return held


def _counts(table: DataFrame, raw) -> np.ndarray:
    """Labelled documents by class and node of their score."""

    def run(batches):
        n = np.zeros((2, 2 * _MOST * _GRID + 1))
        for y, x in _rows(batches):
            node, share = _dealt(raw(x), _MOST, _GRID)
            np.add.at(n, (y, node), 1 - share)
            np.add.at(n, (y, node + 1), share)
        y, node = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(node, pa.int32()), pa.array(n[y, node])], names=["quality", "node", "n"])

    got = table.mapInArrow(run, "quality int, node int, n double").groupBy("quality", "node").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, 2 * _MOST * _GRID + 1))
    n[got.column("quality").to_numpy(), got.column("node").to_numpy()] = got.column("n").to_numpy()
    return n


def _over_pairs(n: np.ndarray, kernel, per_unit: int) -> np.ndarray:
    """At every node, the sum over nodes of n * kernel(this score - that score)."""
    width = 1 << (3 * len(n)).bit_length()
    k = kernel(np.arange(1 - len(n), len(n)) / per_unit)
    return np.fft.irfft(np.fft.rfft(n, width) * np.fft.rfft(k, width), width)[len(n) - 1 : 2 * len(n) - 1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _curve(x: np.ndarray) -> np.ndarray:
    return _sigmoid(x) * _sigmoid(-x)


def _slopes(table: DataFrame, standard, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of all pairs' mean loss at w, where scores have the counts n."""
    pairs = n[0].sum() * n[1].sum()
    used = np.flatnonzero(n.any(0))
    lo, bad, good = used[0], *n[:, used[0] : used[-1] + 1]
    slope = np.stack([_over_pairs(good, _sigmoid, _GRID), -_over_pairs(bad, lambda x: _sigmoid(-x), _GRID)]) / pairs
    node, share = _dealt(np.arange(n.shape[1]) / _GRID - _MOST, _REACH, _COARSE)
    few = np.stack([np.bincount(node, c * (1 - share), _NODES) + np.bincount(node + 1, c * share, _NODES) for c in n])
    kernel = _curve((np.arange(_NODES)[:, None] - np.arange(_NODES)) / _COARSE) / pairs
    curve = few[::-1] @ kernel

    def run(batches):
        gradient, square, sums = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES)), np.zeros((2, _NODES, N_FEATURES))
        for y, x in _rows(batches):
            for q in (0, 1):
                z = standard(x[y == q])
                s = z @ w
                node, share = _dealt(s, _MOST, _GRID)
                gradient += np.interp(node + share - lo, np.arange(slope.shape[1]), slope[q]) @ z
                node, share = _dealt(s, _REACH, _COARSE)
                dealt = np.zeros((len(z), _NODES))
                dealt[np.arange(len(z)), node], dealt[np.arange(len(z)), node + 1] = 1 - share, share
                root = np.sqrt(dealt @ curve[q])[:, None] * z
                square += root.T @ root
                sums[q] += dealt.T @ z
        parts = np.array_split(np.concatenate([gradient, square.ravel(), sums.ravel()]), _PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([v.tobytes() for v in parts], pa.binary())], names=["part", "v"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in rows.column("v").to_pylist())
        return pa.table({"part": rows.column("part")[:1].cast(pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    got = table.mapInArrow(run, "part int, v binary").groupBy("part").applyInArrow(added, "part int, v binary").collect()
    flat = np.frombuffer(b"".join(r["v"] for r in sorted(got)), np.float64)
    gradient, square, sums = np.split(flat, [N_FEATURES, N_FEATURES + N_FEATURES**2])
    bad, good = sums.reshape(2, _NODES, N_FEATURES)
    across = good.T @ kernel @ bad
    return gradient + DECAY * w, square.reshape(N_FEATURES, -1) - across - across.T + DECAY * np.eye(N_FEATURES)


def _at_rank(scores: DataFrame, k: int) -> tuple[float, float]:
    """The k-th smallest score s, from 1, and the one after it in order: by counts over ever smaller stretches."""
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    left = k
    while lo < hi and (width := (hi - lo) / 4096) > 0:
        for row in sorted(scores.where(F.col("s").between(lo, hi)).groupBy(F.floor((F.col("s") - lo) / width)).agg(F.count("*"), F.min("s"), F.max("s")).collect()):
            if left <= row[1]:
                break
            left -= row[1]
        lo, hi = row[2], row[3]
    upto, above = scores.agg(F.count_if(F.col("s") <= lo), F.min(F.when(F.col("s") > lo, F.col("s")))).first()
    return lo, lo if upto > k or above is None else above


def _learnt(table: DataFrame) -> Ranking:
    """The model of a table of labels (quality) and features (x) of every labelled document."""
    (n_bad, n_good), mean, squares = _moments(table)
    if not n_bad or not n_good:
        return Ranking(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0)
    scale = np.sqrt(squares / (n_bad + n_good))
    scale[scale < 1e-9] = 1
    standard = lambda x: (x - mean) / scale

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        n = _counts(table, lambda x: standard(x) @ w)
        used = np.flatnonzero(n.any(0))
        bad, good = n[:, used[0] : used[-1] + 1]
        return float(good @ _over_pairs(bad, lambda x: np.logaddexp(0, -x), _GRID) / n_bad / n_good + DECAY / 2 * w @ w), n

    w = np.zeros(N_FEATURES)
    loss, n = at(w)
    for _ in range(STEPS):
        gradient, curvature = _slopes(table, standard, w, n)
        move = np.linalg.solve(curvature, gradient)
        gain, size = float(gradient @ move), 1.0
        if gain < 1e-6:  # what is left after this step is its square
            w = w - move
            break
        while (got := at(w - size * move))[0] > loss - 1e-4 * size * gain and size > 1e-3:
            size /= 2
        w, (loss, n) = w - size * move, got

    def scores(batches):
        for _, x in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(standard(x) @ w)], names=["s"])

    below, above = _at_rank(written(table.mapInArrow(scores, "s double"), "labelled-scores"), int(n_bad))
    return Ranking(w, mean, scale, (below + above) / 2)


def fit(docs: DataFrame, labels: DataFrame) -> Ranking:
    """labels: doc_id, quality (0 or 1); rows held out must be left out before. Every labelled row of docs is learnt from."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=_AT_ONCE):
                x = features(*text_bytes(part.column("text"))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    id_ = docs.schema["doc_id"].dataType
    with scratch(docs.sparkSession):
        once = labels.select(F.col("doc_id").try_cast(id_).alias("doc_id"), "quality").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        once = written(once.where("quality in (0, 1)"), "labels")
        near, _ = split_by_keys(docs.select("doc_id", "text").where("doc_id is not null"), once, ["doc_id"])
        x = near.mapInArrow(run, f"doc_id {id_.simpleString()}, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))
        return _learnt(written(x.join(once, "doc_id").select("quality", "x"), "labelled-features").coalesce(_TASKS))


def score(docs: DataFrame, model: Ranking, column: str = "quality_score") -> DataFrame:
    """docs with the score (0 to 1) behind its own columns, as `column`; a column that docs has by this name gives way."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    held = [f for f in docs.schema if f.name != column]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=_AT_ONCE):
                got = model.scores(features(*text_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*part.schema.names, column])

    return docs.select([f.name for f in held]).mapInArrow(run, StructType([*held, StructField(column, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Ranking:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(docs.where(~held_out()), labels.where(~held_out()))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    got = score(docs, trained(spark, docs, sf_dir))
    return got.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))
