import hashlib
import zlib

import pytest

from tidewater.llm import op11_merkle as op

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def siblings(found, place):
    """(other or '', whether it stands left) by level."""
    return [(("" if place ^ 1 >= len(level) else level[place ^ 1]), bool(place & 1)) for level, place in ((x, place >> i) for i, x in enumerate(found[:-1]))]


def by_hand(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in (r[:5] for r in rows):
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = leaf(doc_id, text, lang, source, n_chars)
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, leaf(doc_id, text, lang, source, n_chars + 1) if hit else own, doc_id))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {k: levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in order}
    outer = levels([inner[k][-1][0] for k in order])
    got = []
    for at, k in enumerate(order):
        for place, (_, _, own, given, doc_id) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            path = siblings(inner[k], place) + siblings(outer, at)
            now = given
            for other, left in path:
                now = h(other, now) if left else h(now, other)
            got.append((str(doc_id), own, inner[k][-1][0], outer[-1][0], h(*[x for x, _ in path]), now, now == outer[-1][0]))
    return sorted(got)


def run(spark, rows, block):
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    found = op.manifest(op.leaves_of(docs), block)
    proof = op.F.sha2(op.F.array_join(op.F.transform("siblings", lambda s: op.F.substring(s, 2, 64)), "").cast("binary"), 256)
    found = found.withColumn("folded", op.folded(op.F.coalesce("tampered", "digest"), op.F.col("siblings"))).select(op.F.col("key").cast("string"), "digest", "subroot", "root", proof, "folded", op.F.expr("folded = root"))
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("block", [1, 2, 3, 10])
def test_equals_the_definition(spark, block):
    rows = [(i, f"text {i}" * (i % 4), ["en", "de", None, "é", "z"][min(i % 7, 4)], f"s{i % 3}", i if i % 5 else None, "x", "y") for i in range(90)]
    rows += [(None, None, None, None, None, None, None), (None, "a", "en", None, 3, None, None), (7, "text", "only", "s", 4, "", "")]
    rows += [(14, "same", "en", "s", 4, "", "")] * 3 + [(15, "ü" * 70_000, "de", "s", 2**63 - 1, "", ""), (14, "other", "en", "s", 4, "", "")]
    want = by_hand(rows)
    assert run(spark, rows, block) == want
    assert {x[-1] for x in want} == {True, False}


def test_one_leaf_and_none(spark):
    assert run(spark, [(3, "t", None, None, 1, None, None)], 4) == by_hand([(3, "t", None, None, 1)])
    assert run(spark, [], 4) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_climbed_block(n):
    digests = [h(str(i)) for i in range(n)]
    found = levels(digests)
    root, paths = op.climbed(digests, len(found) - 1)
    assert root == found[-1][0]
    assert [[(p[1:], p[:1] == "<") for p in path] for path in paths] == [[(o, left and o != "") for o, left in siblings(found, i)] for i in range(n)]
    higher, paths = op.climbed(digests, len(found) + 1)
    assert higher == h(h(root)) and all(path[-2:] == ["", ""] for path in paths)
