"""Byte-level BPE ids of whole texts, as the tokenizers library gives them.

Texts are cut into letter runs (with the one space before) and the gaps between. The vocabulary's pre-tokenizer always
cuts there too, so a distinct run is encoded once and looked up by its hash after that; a gap also depends on whether a
run follows, and is encoded with one. New runs go to a faster encoder over the same vocabulary and merge order (the
tests hold both equal). Texts with special tokens, letters outside Latin, or apostrophes at the edge of a run go whole
to the library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tidewater.llm.common import mix, noise

CACHE_RUNS = 1_500_000
#: Fixed: the pre-tokenizer's pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0x27, *range(0x80, 256)]] = True
_BYTE, _PLACE = noise(256, 21), noise(256, 22)
_FOLLOWED = noise(3, 23)


def byte_chars() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """held with room for size entries; it doubles where it grows, so that growing copies each entry a few times at most."""
    return held if size <= len(held) else np.resize(held, max(size, 2 * len(held)))


class Ragged:
    """Rows of 32-bit numbers kept by 64-bit key. Keys are in sorted levels, each over twice as large as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = self.used = 0
        self.starts, self.lens, self.flat = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.uint32)

    def __len__(self) -> int:
        return self.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out = np.full(len(keys), -1)
        for held, at in self.levels:
            i = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            hit = np.flatnonzero(held[i] == keys)
            out[hit] = at[i[hit]]
        return out

    def add(self, keys: np.ndarray, rows: list) -> None:
        lens = np.fromiter(map(len, rows), np.int32, len(rows))
        flat = np.fromiter((x for r in rows for x in r), np.uint32, int(lens.sum()))
        n, used = self.n + len(rows), self.used + len(flat)
        self.starts, self.lens, self.flat = _room(self.starts, n), _room(self.lens, n), _room(self.flat, used)
        self.starts[self.n : n], self.lens[self.n : n] = self.used + np.cumsum(lens) - lens, lens
        self.flat[self.used : used] = flat
        level = keys, np.arange(self.n, n)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = tuple(np.append(x, y) for x, y in zip(self.levels.pop(), level, strict=True))
        order = np.argsort(level[0], kind="stable")
        self.levels.append((level[0][order], level[1][order]))
        self.n, self.used = n, used

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and their lengths."""
        lens = self.lens[at]
        ends = np.cumsum(lens, dtype=np.int64)
        index = np.repeat(self.starts[at] - ends + lens, lens)
        index += np.arange(len(index))
        return self.flat[index], lens


def runs(buf: np.ndarray, offsets: np.ndarray):
    """Letter runs (with the one space before) and gaps that tile the texts: starts, lengths, what follows a gap within its
    text (1: a run, 2: a run with a space, 0: nothing, or it is no gap), and the places of runs' first and last letters."""
    letter = _LETTER[buf]
    first = np.zeros(len(buf) + 1, bool)  # a text begins here
    first[offsets] = True
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | first[1:-1]
    heads = np.flatnonzero(begin)
    end = np.zeros(len(buf) + 1, bool)
    end[1:] = letter
    end[1:-1] &= ~letter[1:] | first[1:-1]
    ends = np.flatnonzero(end)
    edges = np.concatenate([heads, ends - 1])
    spaced = (heads > 0) & (buf[heads - 1] == 0x20) & ~first[heads]
    heads = heads - spaced
    cut = first
    cut[heads] = cut[ends] = True
    cuts = np.flatnonzero(cut)
    kind = np.zeros(len(buf) + 1, np.uint8)
    kind[heads] = 1 + spaced
    ahead = kind[cuts[1:]]
    ahead[(kind[cuts[:-1]] > 0) | np.isin(cuts[1:], offsets)] = 0
    return cuts[:-1], np.diff(cuts), ahead, edges


def run_keys(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """64-bit hash of each run's bytes and of what follows."""
    place = np.arange(len(buf)) - np.repeat(starts, lens)
    h = _BYTE[buf]
    h *= _places(int(lens.max()))[place]
    return mix(np.add.reduceat(h, starts) + lens.astype(np.uint64) * _FOLLOWED[0]) ^ (_FOLLOWED[1] * ahead)


def odd_texts(buf: np.ndarray, offsets: np.ndarray, edges: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Texts that must not be cut into runs: special tokens, letters outside Latin, apostrophes at the edge of a run."""
    lead = buf >= 0xC0
    bad = np.flatnonzero(lead & ((buf < 0xC3) | (buf > 0xC9)))
    times = np.flatnonzero(buf == 0xC3)
    times = times[np.isin(buf[np.minimum(times + 1, len(buf) - 1)], (0x97, 0xB7))]
    found = [bad, times, edges[buf[edges] == 0x27]]
    raw = buf.tobytes()
    for s in special:
        at = raw.find(s)
        while at >= 0:
            found.append(np.array([at]))
            at = raw.find(s, at + 1)
    return np.unique(np.searchsorted(offsets, np.concatenate(found), side="right") - 1)


class RunEncoder:
    """ids(buf, offsets): ids of concatenated UTF-8 texts and n + 1 offsets, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        back = {c: b for b, c in byte_chars().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in told["model"]["vocab"].items()}
        self.special = [t["content"].encode() for t in told["added_tokens"]]
        self.ordinary = tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.kept = Ragged()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if len(self.kept) > CACHE_RUNS:
            self.kept = Ragged()
        starts, lens, ahead, edges = runs(buf, offsets)
        odd = odd_texts(buf, offsets, edges, self.special)
        h = run_keys(buf, starts, lens, ahead)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        row = self.kept.find(keys)
        if len(new := np.flatnonzero(row < 0)):
            encode, raw, got = self.ordinary, buf.tobytes(), []
            for a, b, k in zip(starts[at[new]].tolist(), (starts + lens)[at[new]].tolist(), ahead[at[new]].tolist(), strict=True):
                piece = raw[a:b].decode("utf-8", "replace")
                got.append(encode(piece + ("", "x", " x")[k])[: -1 if k else None])
            self.kept.add(keys[new], got)
            row = self.kept.find(keys)
        flat, counts = self.kept.rows(row[back])
        total = np.append(0, np.cumsum(counts, dtype=np.int64))
        bounds = total[np.searchsorted(starts, offsets)]
        if not len(odd):
            return flat, bounds
        parts = np.split(flat, bounds[1:-1])
        raw = buf.tobytes()
        for i, x in zip(odd.tolist(), self.whole([raw[offsets[i] : offsets[i + 1]].decode() for i in odd.tolist()]), strict=True):
            parts[i] = x
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = noise(1 << (n - 1).bit_length(), 22)
    return _PLACE


_HELD: dict[str, RunEncoder] = {}


def run_encoder(path: str) -> RunEncoder:
    """One encoder for each Python worker."""
    if path not in _HELD:
        _HELD[path] = RunEncoder(path)
    return _HELD[path]
