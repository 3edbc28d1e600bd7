from collections import Counter

import numpy as np

from tidewater.llm import op9_embeddings as op


def brute(rows, least=op.LEAST):
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)
    good = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    first = {}
    for i in range(n):
        if rows[i][0] is not None:
            first[root(i)] = min(rows[i][0], first.get(root(i), rows[i][0]))
    return Counter((r[0], links[i], (c := first.get(root(i))), r[0] is not None and r[0] == c) for i, r in enumerate(rows))


def same(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, class int")
    assert Counter(map(tuple, op.near_duplicates(df).collect())) == brute(rows)


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 40 * 8 * 16)
    monkeypatch.setattr(op, "TILE", 8)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(25, 16))
    rows = [(int(i * 13 % 1009), (centre[k := int(rng.integers(25))] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.6])).tolist(), k % 3) for i in range(400)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(5)] + [rows[6], rows[6], (3000, rows[6][1], None), (None, rows[7][1], rows[7][2]), (3001, rows[7][1], rows[7][2])]
    rows += [(3002, None, 1), (3003, [0.0] * 16, 1), (3004, [float("nan")] * 16, 1), (3005, [float("inf")] + [1.0] * 15, 1), (3006, [], 1), (3007, [1.0, None], 1), (3008, [1.0, 2.0], 1), (3009, [2.0, 4.0], 1)]
    same(spark, rows)


def test_links_are_counted_as_they_come(monkeypatch):
    monkeypatch.setattr(op, "TILE", 8)
    monkeypatch.setattr(op, "_HELD", 50)
    rng = np.random.default_rng(1)
    a = op.unit(rng.normal(size=(4, 6))[rng.integers(4, size=90)] + 0.15 * rng.normal(size=(90, 6)))
    a = a[np.lexsort(np.floor(a[:, :2] / 0.4).T)]
    copies = rng.integers(1, 4, 90)
    for other, same_ in ((a, True), (op.unit(a[20:70] + 0.1 * rng.normal(size=(50, 6))), False)):
        b, copies_b = (a, copies) if same_ else (other, copies[20:70])
        near = a @ b.T >= 0.93
        if same_:
            near &= ~np.eye(90, dtype=bool)
        n, (node, root) = op._linked(a, b, a[:, :2], b[:, :2], copies, copies_b, same_, 0.93, np.sqrt(2 - 2 * 0.93) + 1e-9)
        if same_:
            n = n[:90] + n[90:]
            assert (n == near @ copies_b).all()
        else:
            assert (n[:90] == near @ copies_b).all() and (n[90:] == near.T @ copies).all()
        i, j = np.nonzero(near)
        want = op.roots(i, j if same_ else 90 + j)
        got = op.roots(node, root)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op.near_duplicates(df).collect() == []
