"""Language of a document by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vectors of three consecutive characters are
permuted by their place and bound into one by products; a text's vector bundles, that is sums, those of all its letters,
each with its neighbours. A language's prototype bundles its training texts, and a text has the language whose prototype
has the largest cosine with its vector.

Letters are those of Unicode, in lower case; any other character is a boundary, and so are both ends. Vectors are worked
out in each task as products of counts and the vectors of the trigrams that occur, by slices of text and of trigrams of a
bounded size, so that one text may have any length. Sums of prototypes are exact integers: the order of rows doesn't matter.

A text that is null or has no letter is UNKNOWN with score 0, and teaches nothing; so is every text where nothing was
learnt. Rows without doc_id are not held out and teach nothing. Of equal cosines the first language in bytewise order wins.
Repeated rows each count. Languages may be any strings and any number; prototypes reach the tasks in slices of up to about
LANGS languages. Other columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import chunks, documents, mix, scratch, written

DIM = 1024
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
ADDED = ("lang_pred", "score")
#: Languages of a slice of prototypes, 8 KB each, of which the driver and each task hold one.
LANGS = 1024
#: Bytes of text and characters of one text at once, rows of counts and trigrams at once.
_TEXT, _CHARS, _ROWS, _GRAMS = 1 << 19, 1 << 19, 256, 8192
_BOUNDARY = 32
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def letter_signs(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of dim booleans for each code point: where its vector is -1."""
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place in the joined texts and trigram of every letter: before, itself, and behind, 21 bits each."""
    points = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    letter = _letters()[points]
    clean = np.where(letter, points, _BOUNDARY).astype(np.uint64)
    at = np.flatnonzero(letter)
    return owner[at - 1], at - 1, clean[at - 1] << np.uint64(42) | clean[at] << np.uint64(21) | clean[at + 1]


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct trigrams, and each one's index; by counting where few letters occur."""
    parts = [(codes >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)]
    used = np.zeros(0x110000, bool)
    for p in parts:
        used[p] = True
    points = np.flatnonzero(used)
    if len(points) > 128:
        return np.unique(codes, return_inverse=True)
    rank = np.zeros(0x110000, np.int32)
    rank[points] = np.arange(len(points))
    small = (rank[parts[0]] * len(points) + rank[parts[1]]) * len(points) + rank[parts[2]]
    seen = np.flatnonzero(np.bincount(small, minlength=1))
    index = np.zeros(len(points) ** 3, np.int32)
    index[seen] = np.arange(len(seen))
    a, b, c = (points[x].astype(np.uint64) for x in (seen // len(points) ** 2, seen // len(points) % len(points), seen % len(points)))
    return a << np.uint64(42) | b << np.uint64(21) | c, index[small]


def bundles(owner: np.ndarray, codes: np.ndarray, n: int, dim: int = DIM) -> np.ndarray:
    """n rows: the sums of the trigrams' vectors by owner. Owners ascend."""
    out = np.zeros((n, dim))
    if not len(codes):
        return out
    found, index = _distinct(codes)
    for lo in range(0, len(found), _GRAMS):
        part = found[lo : lo + _GRAMS]
        signs = np.zeros((len(part), dim), bool)
        for roll, shift in ((2, 42), (1, 21), (0, 0)):
            points, at = np.unique((part >> np.uint64(shift)) & np.uint64(0x1FFFFF), return_inverse=True)
            signs ^= np.roll(letter_signs(points, dim), roll, axis=1)[at]
        vectors = 1 - 2 * signs.astype(np.float32)
        here = slice(None) if len(found) <= _GRAMS else np.flatnonzero((index >= lo) & (index < lo + _GRAMS))
        own, gram = owner[here], index[here] - lo
        for top in range(0, n, _ROWS):
            a, b = np.searchsorted(own, (top, top + _ROWS))
            rows = min(_ROWS, n - top)
            counts = np.bincount((own[a:b] - top) * len(part) + gram[a:b], minlength=rows * len(part))
            out[top : top + rows] += counts.reshape(rows, -1).astype(np.float32) @ vectors  # whole numbers under 2**24: exact
    return out


def _slices(texts: list[str]):
    """Owners and trigrams of texts, a slice of a long one at a time, which sees one character more on each side."""
    owner, _, codes = grams([t if len(t) <= _CHARS else "" for t in texts])
    yield owner, codes
    for i, t in enumerate(texts):
        for lo in range(0, len(t) if len(t) > _CHARS else 0, _CHARS):
            _, place, codes = grams([t[max(lo - 1, 0) : lo + _CHARS + 1]])
            inner = (place >= min(lo, 1)) & (place < min(lo, 1) + _CHARS)
            yield np.full(int(inner.sum()), i), codes[inner]


def _vectors(texts: list[str], owner_of: np.ndarray, n: int, dim: int) -> np.ndarray:
    """n vectors: those of the texts, summed by owner_of, which ascends."""
    out = np.zeros((n, dim))
    for owner, codes in _slices(texts):
        out += bundles(owner_of[owner], codes, n, dim)
    return out


def _lower(column: pa.Array) -> list[str]:
    return [(t.as_py() or "").lower() for t in column]


def profiles(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(lang, at, total) of every language of docs (lang, text): the coordinates of its prototype."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def told():
            for lang, total in held.items():
                if total.any():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total.astype(np.int64))], names=["lang", "at", "total"])

        for batch in batches:
            for part in chunks(batch, "text", _TEXT):
                langs = np.array(part.column("lang").to_pylist(), object)
                names, own = np.unique(langs.astype(str), return_inverse=True)
                order = np.argsort(own, kind="stable")
                texts = _lower(part.column("text"))
                for lo in range(0, len(names), _ROWS):  # many languages: some at a time
                    mine = order[(own[order] >= lo) & (own[order] < lo + _ROWS)]
                    got = _vectors([texts[i] for i in mine], own[mine] - lo, min(_ROWS, len(names) - lo), dim)
                    for name, row in zip(names[lo : lo + _ROWS].tolist(), got, strict=True):
                        held[name] = held[name] + row if name in held else row
                    if len(held) > LANGS:
                        yield from told()
                        held = {}
        yield from told()

    found = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, at int, total long")
    return found.groupBy("lang", "at").agg(F.sum("total").alias("total"))


def _nearest(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: tuple[str, str], dim: int) -> DataFrame:
    """docs with its columns (language, cosine) improved by the given prototypes."""
    langs = sorted(prototypes, key=str.encode)
    base = np.array([prototypes[x] for x in langs], np.float64).reshape(len(langs), dim)
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", _TEXT):
                n, names = part.num_rows, part.column(columns[0]).to_pylist()
                best = part.column(columns[1]).to_numpy(zero_copy_only=False).copy()
                texts = _lower(part.column("text"))
                for lo in range(0, n, _ROWS):
                    some = texts[lo : lo + _ROWS]
                    got = _vectors(some, np.arange(len(some)), len(some), dim)
                    size = np.linalg.norm(got, axis=1)
                    cosine = (got @ base.T) / np.where(size > 0, size, 1)[:, None]
                    first = cosine.argmax(axis=1)
                    top = cosine[np.arange(len(some)), first]
                    for i in np.flatnonzero(size > 0).tolist():
                        name = langs[first[i]]
                        if top[i] > best[lo + i] or top[i] == best[lo + i] and name.encode() < names[lo + i].encode():
                            best[lo + i], names[lo + i] = top[i], name
                held = {**dict(zip(part.schema.names, part.columns, strict=True)), columns[0]: pa.array(names, pa.string()), columns[1]: pa.array(best)}
                yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    return docs.mapInArrow(run, StructType([*docs.schema.fields]))


def predicted(docs: DataFrame, learnt: DataFrame, columns: tuple[str, str] = ADDED, dim: int = DIM, at_once: int = LANGS) -> DataFrame:
    """docs with the language and the cosine, 0 to 1, behind its own columns; columns that docs has by these names give way."""
    names = [c for c in docs.columns if c not in columns]
    got = docs.select(names).withColumns({columns[0]: F.lit(UNKNOWN), columns[1]: F.lit(-2.0)})
    slices = max(1, math.ceil(learnt.select("lang").distinct().count() / at_once))
    for k in range(slices):
        prototypes: dict[str, np.ndarray] = {}
        for lang, at, total in learnt.where(F.pmod(F.xxhash64("lang"), F.lit(slices)) == k).select("lang", "at", "total").toLocalIterator():
            prototypes.setdefault(lang, np.zeros(dim))[at] = total
        prototypes = {k: v for k, v in prototypes.items() if v.any()}
        if prototypes:
            got = _nearest(got, prototypes, columns, dim)
    return got.withColumn(columns[1], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(columns[1]))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    with scratch(spark):
        learnt = written(profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))), "language-profiles")
        got = predicted(docs.select("doc_id", "text"), learnt)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
