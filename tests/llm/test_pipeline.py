import os
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_op1 import brute as components
from test_op3 import brute as cut
from test_op10 import check

from tidewater.llm import op8_quality
from tidewater.llm.common import shared_dir, text_bytes, written


def odd_columns(spark, rows):
    """Documents with a null id, null and empty and very long texts, and columns named as what the stages compute."""
    odd = [(None, None), (None, "no id here"), (4000, ""), (4001, "very long " * 30_000), (4002, None)]
    kind = "doc_id long, text string, n_chars long, quality_score string, kept_text string, removed_words int, k_id string, class string"
    return spark.createDataFrame([(i, t, len(t or ""), "mine", f"kept {i}", 7, "k", "c") for i, t in [*rows, *odd]], kind)


def test_own_columns_stay_and_tables_end(spark, tmp_path):
    rows, labels = rows_and_labels()
    odd_columns(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.kept_text) for r in docs.collect()}
        docs = written(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        assert docs.columns == ["doc_id", "text", "n_chars", "quality_score", "kept_text", "removed_words", "k_id", "class"]
        assert {(r.doc_id, r.kept_text) for r in got} <= before and len(got) > 50
        assert all(r.quality_score == "mine" and r.kept_text == f"kept {r.doc_id}" and r.removed_words == 7 and r.k_id == "k" for r in got)
    shared = shared_dir(spark).removeprefix("file:")
    held = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.split("-")[0] for x in set(os.listdir(shared)) - held} == {"packing"}
    assert out.count() >= len(got)


def rows_and_labels():
    pick = random.Random(12)
    good = [f"word{i}" for i in range(700)]
    passage = " ".join(pick.choice(good) for _ in range(70))
    rows, labels = [], []
    for i in range(160):
        w = [pick.choice(good) for _ in range(pick.randint(60, 160))]
        bad = i % 5 == 0
        text = " ".join(f"{x.upper()}$$$" for x in w) if bad else " ".join(w)
        if not bad and i % 3 == 0:
            text += "  \n" + passage
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
        if not bad and i % 7 == 0:
            w[3] = "changed"
            rows.append((1000 + i, " ".join(w) + text[len(" ".join(w)) :]))
    rows += [(2000, rows[1][1]), rows[1], (3000, "")]
    return rows, labels


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, labels = rows_and_labels()
    sf = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    took = lambda d: sorted((r.doc_id, r.text) for r in d.collect())

    kept = written(corpus_pipeline.quality(spark, docs, sf), "t1")
    assert kept.columns == docs.columns
    model = op8_quality.trained(spark, docs, sf)
    import pyarrow as pa

    scores = model.scores(op8_quality.features(*text_bytes(pa.array([t for _, t in rows]))))
    assert took(kept) == sorted(r for r, s in zip(rows, scores.tolist(), strict=True) if s >= op8_quality.ACCEPT)
    bad = {i for i, q in labels if not q}
    assert not bad & {i for i, _ in took(kept)} and len({i for i, q in labels if q} - {i for i, _ in took(kept)}) <= 3

    held = took(kept)
    one = written(corpus_pipeline.near_duplicates(spark, kept, sf), "t2")
    assert one.columns == docs.columns
    groups = defaultdict(list)
    by_row = Counter()
    for (i, n, c), k in components(held).items():
        groups[c if n else (i, "empty")].append(i)
        by_row[i] += k
    want = sorted(min(v) for c, v in groups.items())
    assert [i for i, _ in took(one)] == want
    assert set(took(one)) <= set(held)

    held = took(one)
    gone = written(corpus_pipeline.repeats(spark, one, sf), "t3")
    assert gone.columns == docs.columns
    text = dict(held)
    assert took(gone) == sorted((i, k if lost else text[i]) for i, k, _, lost in cut(held, 50))
    assert all(r.n_chars == len(r.text) for r in gone.collect())
    assert any(lost for *_, lost in cut(held, 50))

    packed = corpus_pipeline.packing(spark, gone, sf).collect()
    bins, least = check(took(gone), packed, 1024)
    assert bins <= least + 3
    digest = lambda out: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert digest(corpus_pipeline.run(spark, sf).collect()) == digest(packed)
    assert np.isfinite(scores).all() and public_tokenizers


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_hold_few_texts_at_once(spark):
    """Texts reach Python in small batches, whatever the session had; wide ones would fill an executor's memory."""
    import corpus_pipeline
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeats):
            spark.conf.set(name, "10000")
            docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string").coalesce(1)
            got = stage(spark, docs, "")
            assert got.count() == 3000
            assert max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) <= corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(name, before)
