"""The pipeline against plain versions of its stages, each on its own input."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from sparkloom.llm import queries
from tests.llm.test_corpus import brute_components
from tests.oracle import DATA


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, digest string, TEXT2 string, keep_id long, n_tokens int"


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_run_on_odd_rows(spark, tmp_path, kind):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the cat sat on the mat.", "en", "a", 23), (4, "the cat sat on the mat.", "en", "b", 23), (4, "the cat sat on the mat.", "en", "b", 23), (None, "no id here.", None, None, 11)]
    made = spark.createDataFrame([(*r, 0.5, 1, "d", "t", 9, 8) for r in rows] if kind == "odd" else [], EXTRA)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (None, 1), (2, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() <= docs.count() * (3 if name == "mixing" else 1)
    # quality rejects what has no words, the smallest id stays of the three equal texts, and mixing repeats the text without a source
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert ids.count(3) == 1 and set(ids) == {3, None} if kind == "odd" else ids == []


def test_stages_on_their_own_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for i, (_, work) in enumerate(corpus_pipeline.STAGES):
        work(spark, kept[-1], DATA).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == docs.columns
    start, good, exact, near, mixed, tokens = [k.toPandas() for k in kept]
    scores = queries.op2_quality(spark, DATA).toPandas().set_index("doc_id")
    assert set(good.doc_id) == {i for i in start.doc_id if scores.score[i] >= 0.7}
    assert set(exact.doc_id) == set(good.groupby("text").doc_id.min())
    want = brute_components(list(zip(exact.doc_id, exact.text)), 5, 80)
    assert set(near.doc_id) == {i for i, _, c in want if i == c}
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 3
    assert len(tokens) == len(mixed)
    assert all(h == hashlib.sha256(t.encode()).hexdigest() for h, t in zip(tokens.decoded_sha256, tokens.text))
    assert len(corpus_pipeline.run(spark, DATA).collect()) == len(mixed)
