import itertools
import math
import os
import zlib

import numpy as np
import pytest

from tidewater.llm import op2_hmm as op


def all_paths(m, ids):
    """Likelihood as the sum over every path of states."""
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(ids)):
        p = m.start[path[0]] * m.emit[ids[0], path[0]]
        for a, b, w in zip(path, path[1:], ids[1:], strict=False):
            p *= m.move[a, b] * m.emit[w, b]
        total += p
    return total


def test_recursions_equal_all_paths():
    rng = np.random.default_rng(1)
    m = op.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    lists = [rng.integers(0, 6, n) for n in (6, 5, 5, 1)]
    logs, run = op.forward(m, lists)
    assert np.allclose(np.exp(logs), [all_paths(m, x) for x in lists])
    start, move, emit = op.expected(m, run)
    assert math.isclose(start.sum(), 4) and math.isclose(emit.sum(), 17) and math.isclose(move.sum(), 13)
    step = 1e-6  # counts are the slopes of the log-likelihood
    for s in range(3):
        n = op.Model(m.start, m.move, m.emit.copy())
        n.emit[2, s] *= 1 + step
        assert math.isclose((op.forward(n, lists)[0].sum() - logs.sum()) / step, emit[2, s], rel_tol=1e-3, abs_tol=1e-5)


def test_rounds_raise_the_likelihood(spark):
    rng = np.random.default_rng(2)
    lists = [rng.choice(20, 40, p=rng.dirichlet(np.full(20, 0.2))).astype(np.uint16) for _ in range(60)]
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in lists], "ids binary").repartition(3)
    shares = np.bincount(np.concatenate(lists), minlength=20) + 1.0
    shares /= shares.sum()
    m, seen = op.first_model(shares, 4), []
    for _ in range(4):
        seen.append(sum(op.forward(m, [x])[0][0] for x in lists))
        m = op.baum_welch(rows, m, shares)
    assert seen == sorted(seen)
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and math.isclose(m.start.sum(), 1)


def brute(rows):
    tokens = [["".join(c.lower() if c.isascii() else c for c in t or "").encode().split(), *[0]] for _, t in rows]
    tokens = [[*w[0], b" end"] for w in tokens]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = {}
    for w, held in zip(tokens, out, strict=True):
        for x in w if not held else []:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    return [(i, held, len(w), sum(c.get(x, 0) > 0 for x in w), n, sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)) for (i, _), w, held in zip(rows, tokens, out, strict=True)]


def test_base_and_edges(spark, monkeypatch):
    monkeypatch.setattr(op, "HEAD", 5)
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"W{x}É" for x in rng.zipf(1.5, rng.integers(0, 60)) % 50)) for i in range(80)] + [(None, None), (5, ""), (5, "a"), (5, "a"), (90, "b " * 30_000)]
    got = op.language_model_scores(spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, row_id int, ids string")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isfinite(a[6]) and a[6] < 0


def test_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.language_model_scores(none).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_beats_unigrams_on_held_out(spark):
    got = [r for r in op.op2_hmm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.03 * sum(r.n_tokens for r in got)


def test_every_round_sees_every_training_document(spark, monkeypatch):
    seen, round_ = [], op.baum_welch
    monkeypatch.setattr(op, "baum_welch", lambda rows, m, shares: seen.append(rows.count()) or round_(rows, m, shares))
    docs = spark.range(2500).selectExpr("id as doc_id", "concat('w', id % 7, ' w', id % 11) as text")
    n = docs.where(~op.held_out()).count()
    assert n > 1500 and op.language_model_scores(docs).count() == 2500
    assert seen == [n] * 14


def plain_rounds(m, sequences, shares):
    """Baum-Welch step by step, unscaled and in double precision: start, moves and emissions as lists."""
    states, symbols = range(len(m.start)), range(len(shares))
    start, move, emit = m.start.tolist(), m.move.tolist(), m.emit.tolist()
    for _ in range(op.ROUNDS):
        n_start = [1 / len(states)] * len(states)
        n_move = [[1 / len(states)] * len(states) for _ in states]
        n_emit = [[op.PRIOR * shares[w]] * len(states) for w in symbols]
        for x in sequences:
            ahead = plain_forward(start, move, emit, x)
            back = [[1.0] * len(states)]
            for w in reversed(x[1:]):
                back.insert(0, [sum(move[a][b] * emit[w][b] * back[0][b] for b in states) for a in states])
            p = sum(ahead[-1])
            for t, w in enumerate(x):
                for a in states:
                    here = ahead[t][a] * back[t][a] / p
                    n_emit[w][a] += here
                    if t == 0:
                        n_start[a] += here
                    else:
                        for b in states:
                            n_move[b][a] += ahead[t - 1][b] * move[b][a] * emit[w][a] * back[t][a] / p
        start = [x / sum(n_start) for x in n_start]
        move = [[x / sum(r) for x in r] for r in n_move]
        sums = [sum(n_emit[w][a] for w in symbols) for a in states]
        emit = [[n_emit[w][a] / sums[a] for a in states] for w in symbols]
    return start, move, emit


def plain_forward(start, move, emit, x):
    rows = [[p * e for p, e in zip(start, emit[x[0]], strict=True)]]
    for w in x[1:]:
        rows.append([sum(rows[-1][a] * move[a][b] for a in range(len(start))) * emit[w][b] for b in range(len(start))])
    return rows


@pytest.mark.parametrize("head", [5, 1000])
def test_scores_equal_a_plain_model(spark, monkeypatch, head):
    """The whole query against counts, training and likelihoods worked out word by word, with and without a tail."""
    monkeypatch.setattr(op.vocabulary, "__defaults__", (head,))
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(0, 12)) % 15) for _ in range(40)]
    split = [[*t.split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = {}
    for x in (w for s, h in zip(split, held, strict=True) if not h for w in s[:-1]):
        count[x] = count.get(x, 0) + 1
    own = [w for w in count if sum(c >= count[w] for c in count.values()) <= head]
    assert 0 < len(own) and (len(own) < len(count)) == (head == 5)
    hashed = lambda w: int(op.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    own.sort(key=hashed)
    symbol = {w: i for i, w in enumerate(own)} | {None: len(own) + 1}
    sequences = [[symbol.get(w, len(own)) for w in s] for s in split]
    rest = {w: c for w, c in count.items() if w not in symbol}
    shares = [float(count[w]) for w in own] + [sum(rest.values()) + 1.0, held.count(False) + 1.0]
    shares = [x / sum(shares) for x in shares]
    start, move, emit = plain_rounds(op.first_model(np.array(shares)), [x for x, h in zip(sequences, held, strict=True) if not h], shares)
    got = {r.doc_id: r.score for r in op.language_model_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts) and any(held)
    for i, (s, x) in enumerate(zip(split, sequences, strict=True)):
        want = math.log10(sum(plain_forward(start, move, emit, x)[-1]))
        want += sum(math.log10((rest.get(w, 0) + 1) / (sum(rest.values()) + len(rest) + 1)) for w in s if w not in symbol)
        assert math.isclose(got[i], want, rel_tol=2e-5, abs_tol=2e-5), (i, got[i], want)
