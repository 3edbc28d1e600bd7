import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import op4_backtrack_bpe as op

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def brute(text, library=Tokenizer.from_file(VOCABULARY)):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_equals_library(spark):
    pick = random.Random(3)
    marks = [*"ab'Z é×\n\t  12!.,ßΣσ́e\xa0", "'s", "  ", "日", "the", "ing", "<|endoftext|>", "İ", "ﬁ", "\x1c"]
    plain = [*"aeiotnhsr", "the", "ing", "tion"]
    texts = ["".join(pick.choice(a) for _ in range(pick.randint(0, 30))) for a in (marks, plain) for _ in range(1500)]
    texts += ["a" * n for n in range(80)] + [None, "", "word " * 20_000, "ab" * 3000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "x", "y", 2)], "doc_id long, text string, decoded string, n_tokens int")
    got = op.encode_decode(docs, VOCABULARY).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids, back = brute("x" if r.doc_id is None else texts[r.doc_id])
        assert r.ids == ids and r.decoded == back and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty(spark):
    assert op.encode_decode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
