import math
import random

import public_tokenizers
import regex

from tidewater.llm import op5_trie_counts as op
from tidewater.llm.encoding import PATTERN

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCORES = op.unigrams(VOCABULARY)


def brute(text):
    total = [0, 0, 0.0, 0.0]
    for p in regex.findall(PATTERN, text or ""):
        b = p.encode()
        best, forward = [(0.0, 0)], [1.0]
        for i in range(1, len(b) + 1):
            ends = [(j, SCORES[b[j:i]]) for j in range(i) if b[j:i] in SCORES]
            best.append(max(((best[j][0] + s, best[j][1] - 1) for j, s in ends)))
            forward.append(sum(forward[j] * math.exp(s) for j, s in ends))
        total = [total[0] + 1, total[1] - best[-1][1], total[2] + best[-1][0], total[3] + math.log(forward[-1])]
    return total


def test_equals_each_pretoken_alone(spark):
    pick = random.Random(6)
    marks = [*"ab'Z é×\n\t  12!.,ß", "'s", "  ", "日", "the", "ing", "<|endoftext|>", "tion"]
    texts = ["".join(pick.choice(marks) for _ in range(pick.randint(0, 25))) for _ in range(600)] + [None, "", "same words", "same words", "word,\n" * 20_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, n_tokens int")
    got = op.token_counts(docs, VOCABULARY).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        a, b, c, d = brute("x" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_pretokens, r.n_tokens) == (a, b), texts[r.doc_id]
        assert math.isclose(r.best_log, c, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.forward_log, d, rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_and_pruning():
    assert math.isclose(sum(math.exp(s) for s in SCORES.values()), 1)
    small, large = op.Trie(SCORES, 20), op.Trie(SCORES)
    words = [b"abcdefgh", b"abcdxyz", b" tokens", b" token"] * 5
    assert [small.counts(w) for w in words] == [large.counts(w) for w in words]


def test_empty(spark):
    assert op.token_counts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
