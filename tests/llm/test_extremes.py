"""Texts read in steps, numbers beyond doubles, rows that only their number tells apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbars.llm import quality, simhash, topk


def _texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "ab ", "ab ab ", " ", "\n\n", "é", "xyz"]) for _ in range(n)) for n in (0, 1, 3, 40, 400)]
    return texts + ["", " ", "a", "a a a a a", "\t\t\t", "w" * 50, "aa " * 30, " " * 20 + "end"]


@pytest.mark.parametrize("step", [1, 2, 3, 4, 5, 7, 64, 1 << 20])
def test_features_in_steps_are_those_of_the_whole(step):
    for text in _texts():
        got = np.sort(np.concatenate(list(quality.long_features(text, step))))
        assert got.tolist() == np.sort(quality.features([text])[0]).tolist(), (text[:30], step)


def test_score_of_long_texts_is_that_of_the_whole(spark, monkeypatch):
    texts = [t for t in _texts()]
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    model = quality.Model(vectors, np.ones((quality.DIM, 2), np.float32) * np.array([0, 1], np.float32), np.zeros(2, np.float32))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [r.score for r in quality.score(spark, docs, model).sort("doc_id").collect()]
    votes = model.votes()
    for text, score in zip(texts, want):
        ids = quality.features([text])[0]
        assert score == pytest.approx(1 / (1 + np.exp(-votes[ids].sum(dtype=float) / max(len(ids), 1))), rel=1e-5)
    long = "word " * 300_000 + "x" * 1_500_000
    got = quality.score(spark, spark.createDataFrame([(1, "before"), (2, long), (3, "after")], "doc_id long, text string").coalesce(1), model)
    ids = quality.features([long])[0]
    assert got.filter("doc_id = 2").first().score == pytest.approx(1 / (1 + np.exp(-votes[ids].mean(dtype=float))), rel=1e-5)
    assert got.count() == 3


def test_one_of_each_tells_rows_apart_by_number(spark):
    rows = [(None, f"text number {i} stands quite alone {i * i} {i ** 3}", {"k": i}) for i in range(30)]
    rows += [(7, "one text of several words", {"a": 1}), (7, "one text of several words", {"a": 2}), (3, "one text of several words", {"a": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, odd map<string,int>").repartition(4)
    kept = simhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len([r for r in got if r.doc_id is None]) == 30
    assert [(r.doc_id, r.odd) for r in got if r.doc_id is not None] == [(3, {"a": 3})]


def test_top_k_of_large_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 3, 7, 9]) for _ in range(4)]) for i in range(60)]
    rows += [(60, [1e300, 0.0, 0.0, 0.0]), (61, [-1e308, 0.0, 1.0, 0.0]), (62, [0.5, 0.5, 0.5, 0.5])]
    df = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {r.vec_id: [int(x) for x in r.v] for r in df.collect()}
    assert whole[62] == [32] * 4 and whole[60][0] == int(64e300)
    found = topk.search(spark, df, df.filter(F.col("vec_id") % 4 == 0), k=5, block=16).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 63, 4):
        scores = [(i, max(-topk.LARGEST, min(topk.LARGEST, sum(a * b for a, b in zip(whole[q], v))))) for i, v in whole.items() if i != q]
        assert got[q] == sorted(scores, key=lambda s: (-s[1], s[0]))[:5]
