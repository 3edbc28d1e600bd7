import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import op8_quality as op
from tidewater.llm.common import text_bytes

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    got = op.op8_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("score", "quality", "predicted").collect()
    good = sorted(r.score for r in rows if r.quality == 1)
    bad = sorted(r.score for r in rows if r.quality == 0)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x", "c"), (4, "w " * 50_000, "d")], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (4, 1)], "doc_id long, quality int")
    model = op.fit(docs, labels)
    got = op.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.quality_score <= 1 for r in got)
    assert op.score(docs.limit(0), model).collect() == []
    none = op.fit(docs, labels.where(F.col("quality") == 1))
    assert {r.quality_score for r in op.score(docs, none).collect()} == {0.5}


def plain_features(text):
    """Features of one text, byte by byte and word by word."""
    b = (text or "").encode()
    size = max(len(b), 1)
    shares = [0.0] * (op._PAIR_BINS + len(op._CLASSES))
    for x, y in zip(b, b[1:], strict=False):
        shares[int(op._PAIR_KIND[x << 8 | y])] += 1 / size
    for x in b:
        for k, members in enumerate(op._CLASSES):
            if x in members:
                shares[op._PAIR_BINS + k] += 1 / size
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in re.findall(rb"[^\x20\x09-\x0D]+", b)]
    n = max(len(w), 1)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    mean = sum(map(len, w)) / n
    spread = math.sqrt(max(0.0, sum(len(x) ** 2 for x in w) / n - mean**2))
    return [math.log1p(1000 * x) for x in shares] + [math.log1p(n), len(set(w)) / n, len(set(grams)) / max(len(grams), 1), math.log1p(mean), math.log1p(spread), math.log1p(size)]


def test_features_equal_each_text_alone():
    pick = random.Random(5)
    marks = ["a", "B", "the ", "The ", " ", "\n", "\t", "é", "日", "9", "!", "{", "#", ". ", "\x0b", " ", "the the the "]
    texts = ["".join(pick.choice(marks) for _ in range(pick.randint(0, 80))) for _ in range(200)] + [None, "", " ", "x", "same", "same", "ab c " * 3000]
    got = op.features(*text_bytes(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain_features(t) for t in texts], rtol=1e-9, atol=1e-7)


def test_ranking_equals_plain_steps(monkeypatch):
    """Weights by steps on each pair of the same draws alone, the threshold by counting, and scores from both."""
    monkeypatch.setattr(op, "PAIRS", 40)
    monkeypatch.setattr(op, "STEPS", 12)
    rng = np.random.default_rng(3)
    n = op.N_FEATURES
    good, bad = rng.normal(0.4, 1, (30, n)), rng.normal(0, 1, (20, n))
    got = op.rank(good, bad, 0.4)
    both = [*good.tolist(), *bad.tolist()]
    mean = [math.fsum(r[k] for r in both) / 50 for k in range(n)]
    scale = [math.sqrt(math.fsum((r[k] - mean[k]) ** 2 for r in both) / 50) for k in range(n)]
    even = [[(x - m) / s for x, m, s in zip(r, mean, scale, strict=True)] for r in both]
    draws, w, first, second = np.random.default_rng(7), [0.0] * n, [0.0] * n, [0.0] * n
    for step in range(1, 13):
        pairs = list(zip(draws.integers(30, size=40).tolist(), draws.integers(20, size=40).tolist(), strict=True))
        slope = [op.DECAY * x for x in w]
        for i, j in pairs:
            d = [x - y for x, y in zip(even[i], even[30 + j], strict=True)]
            miss = 1 / (1 + math.exp(math.fsum(x * y for x, y in zip(d, w, strict=True))))
            slope = [s - miss * x / 40 for s, x in zip(slope, d, strict=True)]
        first = [0.9 * a + 0.1 * s for a, s in zip(first, slope, strict=True)]
        second = [0.999 * a + 0.001 * s * s for a, s in zip(second, slope, strict=True)]
        w = [x - op.RATE * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8) for x, a, b in zip(w, first, second, strict=True)]
    assert np.allclose(got.weights, w, rtol=1e-7, atol=1e-9)
    raw = [math.fsum(x * y for x, y in zip(r, w, strict=True)) for r in even]
    below = sum((0.6 / 30 if i < 30 else 0.4 / 20) for i, x in enumerate(raw) if x < got.threshold)
    assert abs(below - 0.4) <= 0.02 + 1e-9  # as many as the labels leave out, but for one document
    want = [1 / (1 + math.exp(-(x - got.threshold + math.log(op.ACCEPT / (1 - op.ACCEPT))))) for x in raw]
    assert np.allclose(got.scores(np.array(both)), want, rtol=1e-7)
    assert [s >= op.ACCEPT for s in want] == [x >= got.threshold for x in raw]


def labelled(n, seed=4):
    """n documents of a few words, every fifth of them bad."""
    pick = random.Random(seed)
    kinds = [["alpha", "beta", "Gamma,", "delta.", "7"], ["beta", "{}", "!!", "9#", "Gamma,"]]
    return [(i, " ".join(pick.choice(kinds[i % 5 == 0]) for _ in range(pick.randint(3, 9))), int(i % 5 > 0)) for i in range(n)]


def test_fit_learns_from_all_pairs(spark):
    """At the weights, the slope of the mean loss over all pairs, listed one by one, is nothing."""
    rows = labelled(150)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = op.fit(docs, labels)
    x = op.features(*text_bytes(pa.array([r[1] for r in rows]))).astype(np.float32).astype(np.float64)
    y = np.array([r[2] for r in rows])
    scale = x.std(0)
    scale[scale < 1e-9] = 1
    assert np.allclose(got.mean, x.mean(0)) and np.allclose(got.scale, scale)
    z = (x - x.mean(0)) / scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, op.N_FEATURES)
    slope = -(d / (1 + np.exp(d @ got.weights))[:, None]).mean(0) + op.DECAY * got.weights
    assert np.abs(slope).max() < 1e-5
    s = np.sort(z @ got.weights)
    assert np.isclose(got.threshold, (s[29] + s[30]) / 2)


def test_fit_takes_every_labelled_document(spark):
    """More of a class than were once learnt from; means and the threshold's rank are of all of them."""
    rows = labelled(4500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    got = op.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    x = op.features(*text_bytes(pa.array([r[1] for r in rows])))
    assert np.allclose(got.mean, x.mean(0), rtol=1e-5, atol=1e-6)
    s = ((x - got.mean) / got.scale) @ got.weights - got.threshold
    assert (s < -1e-4).sum() <= 900 <= (s < 1e-4).sum()  # but for equal scores and features in single precision


def test_rank_among_repeated_scores(spark):
    s = [3.0, -1.0, 3.0, 3.0, 1e9, 2.0, -1e-300, 0.0]
    rows = spark.createDataFrame([(v,) for v in s], "s double")
    order = sorted(s)
    assert [op._at_rank(rows, k) for k in range(1, 8)] == list(zip(order[:-1], order[1:], strict=True))
