import hashlib
import random
import re
from collections import Counter

from tidewater.llm import op6_fingerprints as op


def paragraphs(text):
    return {x for x in re.split(r"\n+|(?<=[.!?])\s+", text) if x}


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1.0 if not a and not b else round(len(a & b) / max(len(a), len(b)), 9)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, after)))
    return Counter(out)


def same(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, part int, keys string")
    got = op.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == brute(rows)
    return got


def test_edits_and_neighbours(spark):
    pick = random.Random(4)
    line = lambda: " ".join(f"w{pick.randrange(500)}é" for _ in range(pick.randint(1, 6))) + pick.choice([".", "!", "", "?"])
    shared = [line() for _ in range(40)]
    rows = [(pick.randint(-40, 400), pick.choice(["\n", " ", "\n\n"]).join(pick.choice([line(), pick.choice(shared)]) for _ in range(pick.choice([0, 1, 3, 20, 90])))) for _ in range(70)]
    rows += [rows[3], rows[3], (500, rows[4][1]), (None, "x. y. z"), (None, None), (501, ""), (502, "word. " * 9000), (503, "\n".join(f"line {i}" for i in range(3000)))]
    got = same(spark, rows)
    texts = {}
    for r in got:
        if r.doc_id is not None and r.doc_id >= 500:
            texts[r.doc_id] = r.fingerprint
    assert texts[500] in {r.fingerprint for r in got if r.doc_id == rows[4][0]}


def test_few_rows(spark):
    same(spark, [(1, "a. b. c. d")])
    same(spark, [(1, "a. b."), (2, None)])
    assert op.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def hashes(spark, keys):
    """xxhash64 of each key alone, with 0, 1, 2 (its places) and with 7 (its check)."""
    rows = spark.createDataFrame([(k,) for k in keys], "k long").selectExpr("k", *[f"xxhash64(k, {i}) as h{i}" for i in (0, 1, 2, 7)]).collect()
    return {r.k: r for r in rows}


def rebuilt(keys, of):
    """The fingerprint of digests, cell by cell."""
    size = op.LEAST
    while size < len(keys):
        size *= 2
    cells = {}
    for k in keys:
        for t in range(3):
            i = t * size + (of[k][f"h{t}"] & (size - 1))
            n, x, c = cells.get(i, (0, 0, 0))
            cells[i] = (n + 1, x ^ k, c ^ of[k].h7)
    hex_ = lambda x: f"{x & (1 << 64) - 1:X}"
    return " ".join([str(size), " ".join(f"{hex_(i)}:{n}:{hex_(k)}:{hex_(c & 4294967295)}" for i, (n, k, c) in sorted(cells.items()))])


def test_fingerprints_are_sketches_of_the_digests(spark):
    pick = random.Random(6)
    texts = ["\n".join(f"line {pick.randrange(300)}." for _ in range(n)) for n in (0, 1, 2, 15, 16, 17, 40, 200)]
    got = {r.doc_id: r for r in op.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    all_ = [(i, k, t) for i, text in enumerate(texts) for k, t in ((0, text), (1, text[: len(text) - len(text) // 3] + texts[i - 1][: len(text) // 3]))]
    kinds = {r.p: r.d for r in spark.createDataFrame([(p,) for p in {p for *_, t in all_ for p in paragraphs(t)}], "p string").selectExpr("p", "xxhash64(p) as d").collect()}
    of = hashes(spark, list(kinds.values()))
    for i, edited, t in all_:
        assert (got[i].edited_fingerprint if edited else got[i].fingerprint) == rebuilt([kinds[p] for p in paragraphs(t)], of)


def test_recovered_digests_are_the_set_differences(spark):
    rng = random.Random(3)
    draw = lambda n: rng.sample(range(1, 5000), n)
    pairs = [(i, i % 2, draw(rng.choice([0, 1, 5, 60, 400])), draw(rng.choice([0, 1, 5, 60, 400]))) for i in range(40)]
    pairs += [(100, 0, list(range(3000)), list(range(10, 3010))), (101, 0, [7, 8], [7, 8])]
    df = spark.createDataFrame(pairs, "row_id long, which int, keys_a array<long>, keys_b array<long>")
    want = Counter((r, w, k, f) for r, w, a, b in pairs for f, s in ((True, set(a) - set(b)), (False, set(b) - set(a))) for k in s)
    for first in (None, "8L"):  # 8 cells are far too few for most: they are peeled again at larger sizes
        assert Counter((r.row_id, r.which, r.digest, r["first"]) for r in op.recovered(df, first).collect()) == want


def test_short_lines_are_cut_into_sentences(spark):
    def alike(a, b):
        a, b = ({x for x in re.split(r"\n+|(?<=[.!?])\s+", t) if x} for t in (a, b))
        return len(a & b) / max(len(a), len(b))

    texts = ["One two. Three four! Five six? Seven.", "Other words. \n Three four! Five six? More words here.", "A line.\nNo end here\nTwo. Parts. Of. One. Line."]
    got = {r.doc_id: r for r in op.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        after, third = texts[i - 1], len(text) // 3
        assert abs(got[i].near_edited - alike(text, text[: len(text) - third] + after[:third])) < 1e-9
        assert abs(got[i].near_next - alike(text, after)) < 1e-9
    assert got[0].near_edited > 0.3 and got[1].near_next > 0
