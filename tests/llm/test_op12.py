import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import op12_langid as op

SF = "/root/testdata/sf0.01"
DIM = 128


def vector(text, dim=DIM):
    """The definition, a letter at a time."""
    sign = lambda c: 1 - 2 * op.letter_signs(np.array([ord(c)]), dim)[0].astype(int)
    text = f" {''.join(c if c.isalpha() else ' ' for c in (text or '').lower())} "
    total = np.zeros(dim, int)
    for i in range(1, len(text) - 1):
        if text[i] != " ":
            total += np.roll(sign(text[i - 1]), 2) * np.roll(sign(text[i]), 1) * sign(text[i + 1])
    return total


def by_hand(train, text, dim=DIM):
    prototypes = {}
    for lang, t in train:
        if lang is not None and t is not None and vector(t, dim).any():
            prototypes[lang] = prototypes.get(lang, 0) + vector(t, dim)
    v = vector(text, dim)
    if not v.any() or not prototypes:
        return op.UNKNOWN, 0.0
    cosine = {k: (v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for k, p in prototypes.items()}
    best = max(sorted(cosine, key=str.encode), key=cosine.get)
    return best, float(np.clip(cosine[best], 0, 1))


TEXTS = ["The cat sat on the mat", "", None, "12 .,!", "Über die Brücke", "ÉTÉ à la plage", "x", "日本語の文章です", "a\u0000b \n c", "the the the " * 3000, "Straße İstanbul ΣΑΣ"]


@pytest.mark.parametrize("at_once", [1, 2, 100])
def test_equals_the_definition(spark, at_once):
    train = [("en", "the cat and the dog sat on that mat"), ("de", "der Hund und die Katze über der Brücke"), ("fr", "le chat et la plage en été"), ("ja", "日本語です"), (None, "no language"), ("zz", None), ("yy", "1 2 3"), ("de", "der Hund und die Katze über der Brücke")]
    learnt = op.profiles(spark.createDataFrame(train, "lang string, text string"), DIM)
    docs = spark.createDataFrame([(i, t, "own", i) for i, t in enumerate(TEXTS)] + [(None, "the cat", None, None)] * 2, "doc_id long, text string, lang_pred string, lang long")
    got = op.predicted(docs, learnt, dim=DIM, at_once=at_once)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        lang, score = by_hand(train, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_slices_of_long_texts(monkeypatch):
    texts = ["Eine lange Zeile mit Wörtern, und noch eine.", "", "kurz", "abcdefghijklmnopqrstuvwxyz" * 3]
    whole = op._vectors([t.lower() for t in texts], np.arange(4), 4, DIM)
    assert [row.tolist() for row in whole] == [vector(t).tolist() for t in texts]
    for chars, grams, rows in ((1, 8192, 256), (7, 5, 1), (10, 3, 2)):
        monkeypatch.setattr(op, "_CHARS", chars)
        monkeypatch.setattr(op, "_GRAMS", grams)
        monkeypatch.setattr(op, "_ROWS", rows)
        assert (op._vectors([t.lower() for t in texts], np.arange(4), 4, DIM) == whole).all()


def test_many_letters():
    text = "".join(chr(0x4E00 + i) for i in range(3000))
    assert (op._vectors([text], np.zeros(1, int), 1, 64)[0] == vector(text, 64)).all()


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    none = op.profiles(docs.select(F.lit(None).cast("string").alias("lang"), "text"), DIM)
    assert {(r.lang_pred, r.score) for r in op.predicted(docs, none, dim=DIM).collect()} == {(op.UNKNOWN, 0.0)}
    some = op.profiles(docs.select(F.lit("en").alias("lang"), "text"), DIM)
    assert op.predicted(docs.limit(0), some, dim=DIM).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    rows = op.op12_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
