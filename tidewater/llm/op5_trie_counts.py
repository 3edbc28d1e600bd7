"""Token counts under a unigram model, with one dynamic programme for all pre-tokens that share a prefix.

Every distinct pre-token is a path in a trie. A node's scores depend on its prefix alone: the best score and its number of
tokens, and the forward score (log of the summed probability of all segmentations), over the tokens that end there. So they
are computed once, when the node is made, and a pre-token's counts are stored at its last node. A worker keeps its trie
between batches up to `NODES`, and texts are looked up by runs (see encoding), so nothing is shuffled.

The model's tokens are those of a byte-level vocabulary, with the probability 1 / (rank + 2), normalised: vocabularies list
frequent tokens first. Of equally good segmentations the one of fewer tokens counts. Null texts are empty: no tokens.
Special tokens' strings are ordinary text. Repeated rows give repeated results; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, text_bytes
from tidewater.llm.encoding import PATTERN, byte_chars, odd_texts, run_keys, runs

NODES, KEPT = 600_000, 1_500_000


def unigrams(path: str) -> dict[bytes, float]:
    """Log-probability of every token of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in byte_chars().items()}
    ranked = [t for t, _ in sorted(vocabulary.items(), key=lambda x: x[1])]
    total = math.log(math.fsum(1 / (r + 2) for r in range(len(ranked))))
    return {bytes(back[c] for c in t): -math.log(r + 2) - total for r, t in enumerate(ranked)}


class Trie:
    """counts(pre-token): tokens of its best segmentation, its score, and the forward score."""

    def __init__(self, scores: dict[bytes, float], most: int = NODES):
        self.scores, self.longest, self.most = scores, max(map(len, scores)), most
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens, self.forward = [0.0], [0], [0.0]

    def counts(self, text: bytes) -> tuple[int, float, float]:
        if len(self.best) > self.most:
            self.clear()
        child, node, path = self.child, 0, [0]
        for i, b in enumerate(text, 1):
            key = node << 8 | b
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = len(self.best)
                self._score(text, i, path)
            path.append(node)
        return self.tokens[node], self.best[node], self.forward[node]

    def _score(self, text: bytes, i: int, path: list[int]) -> None:
        best, tokens, parts = -math.inf, 0, []
        for j in range(max(0, i - self.longest), i):
            p = self.scores.get(text[j:i])
            if p is not None:
                at = path[j]
                s, n = self.best[at] + p, self.tokens[at] + 1
                if s > best or s == best and n < tokens:
                    best, tokens = s, n
                parts.append(self.forward[at] + p)
        top = max(parts)
        self.best.append(best)
        self.tokens.append(tokens)
        self.forward.append(top + math.log(math.fsum(math.exp(x - top) for x in parts)))


class Counter:
    """Sums of (pre-tokens, tokens, best score, forward score) by text."""

    def __init__(self, path: str):
        import regex

        self.trie, self.split = Trie(unigrams(path)), regex.compile(PATTERN)
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((0, 4))

    def _of(self, pretokens: list[str]) -> tuple[float, ...]:
        got = [self.trie.counts(p.encode()) for p in pretokens]
        return (len(got), *(math.fsum(x) for x in zip(*got, strict=True))) if got else (0, 0, 0.0, 0.0)

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros((n, 4))
        if len(self.keys) > KEPT:
            self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((0, 4))
        starts, lens, ahead, edges = runs(buf, offsets)
        keys, at, back = np.unique(run_keys(buf, starts, lens, ahead), return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(keys, self.keys))
        raw = buf.tobytes()
        if len(new):
            got = []
            for a, b, k in zip(starts[at[new]].tolist(), (starts + lens)[at[new]].tolist(), ahead[at[new]].tolist(), strict=True):
                pieces = self.split.findall(raw[a:b].decode("utf-8", "replace") + ("", "x", " x")[k])
                got.append(self._of(pieces[: -1 if k else None]))
            order = np.argsort(np.append(self.keys, keys[new]), kind="stable")
            self.keys, self.sums = np.append(self.keys, keys[new])[order], np.concatenate([self.sums, np.array(got, float)])[order]
        rows = self.sums[np.searchsorted(self.keys, keys)][back]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        out = np.stack([np.bincount(owner, weights=rows[:, c], minlength=n) for c in range(4)], 1)
        for i in odd_texts(buf, offsets, edges, []).tolist():
            out[i] = self._of(self.split.findall(raw[offsets[i] : offsets[i + 1]].decode()))
        return out


_HELD: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens (of the best segmentation), best_log and forward_log (natural) per row."""

    def run(batches):
        if vocabulary not in _HELD:
            _HELD[vocabulary] = Counter(vocabulary)
        counter = _HELD[vocabulary]
        for batch in batches:
            for part in chunks(batch):
                got = counter.texts(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[:, c].astype(np.int64)) for c in (0, 1)), *(pa.array(got[:, c]) for c in (2, 3))], names=["doc_id", "n_pretokens", "n_tokens", "best_log", "forward_log"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, best_log double, forward_log double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
