import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm import op7_rans_files as op

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    library, at, out = Tokenizer.from_file(VOCABULARY), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def key(r):
    return (r[0] is not None, *[x or 0 for x in r])


def test_whole_table_equals_library(spark):
    rows = [(7, "b c"), (3, None), (5, ""), (4, "word " * 30_000), (5, "it's <|endoftext|> 日本"), (9, "b c"), (9, "b c"), (-2, "x  y \n z")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, start string, n_ids int")
    got = op.read_tokens(op.token_segments(docs, VOCABULARY, segment_ids=5_000)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.read_tokens(op.token_segments(docs, VOCABULARY)).collect() == []


@pytest.mark.parametrize("n", [1, 63, 64, 65, op.BLOCK, 3 * op.BLOCK + 77])
def test_round_trip(n):
    ids = (np.random.default_rng(n).pareto(1, n) * 3).astype(np.uint32) % 50_000
    data = op.encode_segment(ids)
    assert np.array_equal(op.decode_segment(data), ids)
    blocks = -(-n // op.BLOCK)
    assert np.array_equal(op.decode_segment(data, range(blocks - 1, blocks)), ids[(blocks - 1) * op.BLOCK :])


def test_one_symbol_and_damage():
    ids = np.full(1000, 5, np.uint32)
    assert np.array_equal(op.decode_segment(op.encode_segment(ids)), ids)
    data = bytearray(op.encode_segment(np.arange(5000, dtype=np.uint32) % 700))
    data[-9] ^= 1
    with pytest.raises(ValueError):
        op.decode_segment(bytes(data))
