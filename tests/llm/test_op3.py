import random

from tidewater.llm import common
from tidewater.llm import op3_repeats as op


def brute(rows, n):
    first, out = {}, []
    last = (1 << 63) - 1
    for i, text in rows:
        w = (text or "").encode().split()
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            first[k] = min(first.get(k, last), last if i is None else i)
    for i, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < (last if i is None else i):
                gone.update(range(a, a + n))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w) - len(gone), len(gone)))
    return out


def same(spark, rows, n):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, places int, kept_text string")
    got = op.remove_repeats(docs, n)
    assert got.columns == ["doc_id", "text", "places", "kept_text", "kept_words", "removed_words"]
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted([(r.doc_id, r.kept_text, r.kept_words, r.removed_words) for r in got.collect()], key=key) == sorted(brute(rows, n), key=key)


def test_whole_windows(spark):
    pick = random.Random(4)
    vocabulary = [f"w{i}É" for i in range(3000)]
    passage = [pick.choice(vocabulary) for _ in range(130)]
    rows = []
    for i in range(120):
        w = [pick.choice(vocabulary) for _ in range(pick.randint(0, 200))]
        for _ in range(pick.randint(0, 2)):
            a, n = pick.randint(0, 60), pick.choice([49, 50, 51, 70])
            at = pick.randint(0, len(w))
            w[at:at] = passage[a : a + n]
        rows.append((pick.randint(-50, 5000), " \n".join(w) if i % 3 else " ".join(w)))
    rows += [(rows[0][0], rows[1][1]), rows[5], rows[5], (9000, rows[7][1]), (None, rows[7][1]), (None, None), (3, ""), (8000, "er " * 3000), (8001, "er " * 70)]
    same(spark, rows, 50)


def test_short_windows_and_ties(spark):
    pick = random.Random(9)
    same(spark, [(i // 2, " ".join(pick.choice("ab") for _ in range(pick.randint(0, 12)))) for i in range(60)], 4)


def test_empty(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_marks_are_shuffled(spark, monkeypatch):
    """Beyond the bound on what is sent to every task, rows go to their keys by shuffle, with the same result."""
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(i, text if i % 3 else f"own {i}", "x") for i in range(40)], "doc_id long, text string, key_hash string")
    few = sorted(map(str, op.remove_repeats(docs).collect()))
    monkeypatch.setattr(common.split_by_keys, "__defaults__", (0,))
    assert sorted(map(str, op.remove_repeats(docs).collect())) == few
    assert sum(r.removed_words for r in op.remove_repeats(docs).collect()) == 70 * 25
