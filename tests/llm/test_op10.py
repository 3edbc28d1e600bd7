import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import op10_packing as op
from tidewater.llm.common import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, out, most, library=Tokenizer.from_file(VOCABULARY)):
    want = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % most if len(ids) > most and len(ids) % most else min(most, len(ids))
        cuts = [0, *range(first, len(ids), most), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([tuple(r)[:5] for r in out], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= most
    total = sum(r.length for r in out)
    return len(bins), -(-total // most)


def test_pieces_and_bins(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "word " * int(rng.integers(0, 300))) for i in range(900)] + [(None, None), (3, ""), (3, "a b"), (-5, "xyz " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, part int, sequence_id string")
    table = written(op.pieces(docs, VOCABULARY), "pieces")
    bins, least = check(rows, op.pack(table).collect(), op.SEQUENCE)
    assert bins <= least + 1
    bins, least = check(rows, op.pack(table, part_pieces=40).collect(), op.SEQUENCE)
    assert bins <= least + 2


def test_pools_are_bounded(spark, monkeypatch):
    rng, sizes = np.random.default_rng(8), []
    once = op._pack_round
    monkeypatch.setattr(op, "_pack_round", lambda df, *a: sizes.append(max(r["count"] for r in df.groupBy("part").count().collect())) or once(df, *a))
    rows = [(i, "word " * int(rng.integers(300, 700))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = written(op.pieces(docs, VOCABULARY), "pieces")
    got = op.pack(table, part_pieces=40, pool_pieces=80).collect()
    check(rows, got, op.SEQUENCE)
    assert max(sizes) < 160
    whole = op.pack(table).collect()
    assert len({r.sequence_id for r in got}) <= 1.1 * len({r.sequence_id for r in whole})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.pack(written(op.pieces(docs, VOCABULARY), "pieces")).collect() == []


def test_bound_never_exceeds_the_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 21, int(rng.integers(1, 8)))
        assert op.lower_bound(lengths, 20) <= best(lengths.tolist(), 20) <= op.best_fit(lengths, 20)[2]


def best(lengths, most):
    def place(i, bins):
        if i == len(lengths):
            return len(bins)
        found = 99
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= most:
                bins[b] += lengths[i]
                found = min(found, place(i + 1, bins))
                bins[b] -= lengths[i]
        return min(found, place(i + 1, [*bins, lengths[i]]))

    return place(0, [])
