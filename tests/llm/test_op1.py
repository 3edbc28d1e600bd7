import random
from collections import Counter

import numpy as np

from tidewater.llm import op1_jaccard as op


def brute(rows):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def same(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n int, class string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_chains_copies_and_passages(spark):
    pick = random.Random(8)
    vocabulary = [f"W{i}é" for i in range(900)]
    passage = [pick.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(25):
        w = [pick.choice(vocabulary) for _ in range(pick.choice([3, 6, 40, 150, 400]))]
        for _ in range(pick.randint(1, 12)):
            w = list(w)
            for _ in range(pick.randint(0, 1 + len(w) // 60)):
                w[pick.randrange(len(w))] = pick.choice(vocabulary)
            rows.append((len(rows) * 7 % 997, " ".join(w)))
        rows.append((2000 + base, " ".join(passage + [pick.choice(vocabulary) for _ in range(pick.randint(5, 30))])))
    rows += [(5000, rows[3][1]), (5000, rows[4][1]), rows[6], rows[6], (None, rows[8][1]), (None, "lone words here"), (None, None), (1, ""), (7000, "Aa bB"), (7001, "aA BB"), (7002, "é É"), (7003, "é é"), (8000, "er " * 20_000)]
    same(spark, rows)


def test_one_large_group_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    pick = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(pick.randint(0, 4)):
            w[pick.randrange(120)] = f"x{pick.randrange(9)}"
        rows.append((i, " ".join(w)))
    same(spark, rows)


def test_copies_just_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 8)
    monkeypatch.setattr(op, "LEAF", 4)
    pick = random.Random(9)
    rows = []
    for i in range(120):
        w = [f"w{k}" for k in range(150)]
        for _ in range(pick.randint(1, 8)):
            w[pick.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = brute(rows)
    assert 3 < len({c for _, _, c in got}) < 120  # several components, by chance and by chains
    same(spark, rows)


def test_blocks_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_SHINGLES", 500)
    pick = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        w = list(base)
        w[pick.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w[: 300 + 10 * (i % 11)])))
    same(spark, rows)


def test_exactly_the_threshold(spark):
    words = [f"w{i}" for i in range(200)]
    short = " ".join(words[:79])  # 75 shingles of 100: the similarity is 0.75
    rows = [(1, " ".join(words[:104])), (2, short), (3, " ".join(words[:78])), (4, " ".join(words[100:179]))]
    assert brute(rows)[(2, 75, 1)] == 1
    same(spark, rows)


def test_overlaps_are_exact(monkeypatch):
    monkeypatch.setattr(op, "_COLUMNS", 64)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, rng.integers(200, 300), replace=False), rng.integers(0, 1 << 48, 20, dtype=np.uint64))) for _ in range(90)]
    points = np.array([np.bincount((s >> np.uint64(41)).astype(int), minlength=op.GROUPS) for s in sets])
    label = np.arange(90) // 2
    side = np.arange(90) % 3 == 0
    for sides in (None, side.astype(int)):
        got = {tuple(sorted(x)) for x in zip(*(v.tolist() for v in op.linked(sets, points, label, sides)), strict=True)}
        want = set()
        for i in range(90):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if label[i] != label[j] and (sides is None or side[i] != side[j]) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    want.add((j, i))
        assert got == want and want


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (9, op.GROUPS)) * (rng.random((9, op.GROUPS)) < 0.3)
    points = np.maximum(0, base[rng.integers(0, 9, 400)] + rng.integers(-1, 2, (400, op.GROUPS)) * (rng.random((400, op.GROUPS)) < 0.2)).astype(np.int64)
    n, label = points.sum(1), np.arange(400)
    tree = op.CountTree(points, n, label, np.arange(400))
    near = op.reaches(np.minimum(points[:, None], points[None]).sum(2), n[:, None], n[None])
    met = np.zeros((400, 400), bool)
    for p, q in tree.pairs(tree):
        met[np.ix_(p, q)] = met[np.ix_(q, p)] = True
    assert met[near].all() and not met.all() and near.sum() > 800


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(5, long), (3, long + " more"), (None, long), (None, long), (8, ""), (8, ""), (None, None), (2, "lone text"), (2, "lone text"), (2, "other text")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, k_id int, text_key string")
    got = op.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, long + " more"), (8, ""), (8, ""), (None, None), (2, "lone text"), (2, "other text")])
