"""BPE by backtracking: longest token matches, checked pair by pair, give the merges' own result in linear time.

A pre-token (bytes in their printable stand-ins, the last with the word-end mark) is matched against all tokens at once by
an Aho-Corasick automaton, which lists for every place the tokens that begin there. The encoder takes the longest, keeps it
if it is compatible with the token before, else tries the next shorter, else takes the last token back. Two tokens are
compatible if merging their text gives just these two; that is found by undoing merges from the later one on, and kept in a
table. Decoding looks up each id's bytes in one table of offsets.

Normalisation and pre-tokens are the vocabulary's own. Distinct space-separated pieces are encoded once per worker and
looked up by hash after that. Null texts are empty: no ids. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import chunks, documents, mix, noise, text_bytes
from tidewater.llm.encoding import Ragged, byte_chars

CACHE_PIECES = 1_500_000
END = "￿"
_BYTE, _PLACE = noise(256, 31), noise(256, 32)


class BacktrackEncoder:
    """Merges of one vocabulary file, without running them."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise, self.pretokens = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.suffix = told["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in told["model"]["vocab"].items()}
        marked = {self._marked(t): i for t, i in told["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self._by_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the pair that first makes it
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            a, b = marked[self._marked(a)], marked[self._marked(b)]
            made = marked[self._marked(self.tokens[a] + self.tokens[b])]
            if (a, b) not in self.merged:
                self.merged[a, b] = (r, made)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), r
        self.automaton = ahocorasick.Automaton()
        for t, i in marked.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.stand_in = byte_chars()
        self.kept, self.words = Ragged(), {}

    def _marked(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave left + right as these two tokens."""
        key = (left, right)
        if (found := self.compatible.get(key)) is None:
            if len(self.compatible) > 500_000:
                self.compatible.clear()
            found = self.compatible[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Undoes the latest merge on either side of the border; a pair across it that merges before that one spoils both."""
        limit = 1 << 60  # only merges ranked below this have been done by the time looked at
        while True:
            rank = self.merged.get((left, right), (limit, 0))[0]
            if rank < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # of equal ranks the merge further left is done first
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def encode(self, text: str) -> list[int]:
        """ids of one pre-token, already marked at its end."""
        if (found := self.words.get(text)) is not None:
            return found
        at: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, (n, i) in self.automaton.iter(text):
            at[end - n + 1].append((n, i))
        for found in at:
            found.sort()  # the longest last
        ids, places, place, dead = [], [], 0, [False] * (len(text) + 1)
        tries = list(at[0])
        while place < len(text):
            while tries:
                n, i = tries.pop()
                if not dead[place + n] and (not ids or self.fits(ids[-1], i)):
                    ids.append(i)
                    places.append((place, tries))
                    place += n
                    tries = list(at[place]) if place < len(text) else []
                    break
            else:
                dead[place] = True
                ids.pop()
                place, tries = places.pop()
        if len(self.words) > 200_000:
            self.words.clear()
        self.words[text] = ids
        return ids

    def piece(self, raw: str) -> list[int]:
        """ids of a stretch of text between spaces."""
        out = []
        for part in self._by_special.split(raw) if self._by_special else [raw]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for token, _ in self.pretokens(self.normalise(part)):
                    out += self.encode(token + END if self.suffix else token)
        return out

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of concatenated UTF-8 texts, and n + 1 offsets. Texts are cut at single spaces, where no pre-token can span."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.kept) > CACHE_PIECES:
            self.kept = Ragged()
        solid = buf != 0x20
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        inner = offsets[:-1][offsets[:-1] < len(buf)]
        begin[inner] = solid[inner]
        starts, at = np.flatnonzero(begin), np.flatnonzero(solid)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first = np.searchsorted(at, starts)
        lens = np.diff(np.append(first, len(at)))
        h = _BYTE[buf[at]]
        h *= _places(int(lens.max()))[np.arange(len(at)) - np.repeat(first, lens)]
        h = mix(np.add.reduceat(h, first) + lens.astype(np.uint64))
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        row = self.kept.find(keys)
        if len(new := np.flatnonzero(row < 0)):
            raw = buf.tobytes()
            spans = zip(starts[where[new]].tolist(), (starts + lens)[where[new]].tolist(), strict=True)
            self.kept.add(keys[new], [self.piece(raw[a:b].decode()) for a, b in spans])
            row = self.kept.find(keys)
        flat, counts = self.kept.rows(row[back])
        return flat, np.append(0, np.cumsum(counts, dtype=np.int64))[np.searchsorted(starts, offsets)]


class OffsetDecoder:
    """Text of ids: all tokens' bytes in one array, found by offset; tokens are joined as the library joins them where a vocabulary names no decoder."""

    def __init__(self, tokens: dict[int, str], between: bytes = b" "):
        size = max(tokens) + 1
        each = [tokens.get(i, "").encode() + between for i in range(size)]
        self.cut, self.lens = len(between), np.array([len(x) for x in each], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.bytes = np.frombuffer(b"".join(each), np.uint8)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        index = np.repeat(self.starts[ids] - ends + lens, lens)
        index += np.arange(len(index))
        out = self.bytes[index].tobytes()
        at = np.append(0, ends)[bounds]
        return [out[a : max(a, b - self.cut)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = noise(1 << (n - 1).bit_length(), 32)
    return _PLACE


_HELD: dict[str, tuple[BacktrackEncoder, OffsetDecoder]] = {}


def codec(path: str) -> tuple[BacktrackEncoder, OffsetDecoder]:
    """One encoder and decoder for each Python worker."""
    if path not in _HELD:
        encoder = BacktrackEncoder(path)
        _HELD[path] = encoder, OffsetDecoder(encoder.tokens)
    return _HELD[path]


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded text where asked for."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        kind += ", ids array<int>, decoded string"

    def run(batches):
        encoder, decoder = codec(vocabulary)
        for batch in batches:
            for part in chunks(batch):
                ids, at = encoder.ids(*text_bytes(part.column("text")))
                packed = ids.astype("<u4")
                texts = decoder.texts(ids, at)
                cols = [
                    part.column("doc_id"),
                    np.diff(at),
                    [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                    [hashlib.sha256(t).hexdigest() for t in texts],
                ]
                if with_ids:
                    cols += [[packed[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], [t.decode() for t in texts]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
