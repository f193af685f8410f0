"""The factorization machine: pair sums, interactions, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, score string, label int, terms string"


def test_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(1)
    weight, factor = r.normal(size=9), r.normal(size=(9, 3))
    rows = [np.array(x, np.int64) for x in ([], [2], [0, 4, 8], list(range(9)))]
    got = toxicity.margins(rows, weight, factor, 0.5)[0]
    for row, value in zip(rows, got):
        pairs = sum(factor[i] @ factor[j] for i in row for j in row if i < j)
        assert value == pytest.approx(0.5 + weight[row].sum() + pairs)


def test_learns_what_single_terms_cannot(spark):
    """Neither term alone is bad, nor is their absence: only both or none of the pair differ."""
    r = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = r.choices(["uno", "due", "tre"], k=5) + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(words), "s", 1, "t"))
        labels.append((i, int(a and b or not (a or b))))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2, 0.35])
def test_pairs_of_words_that_say_nothing_alone(spark, share):
    """Rows with one word are as often bad as rows without: only both together are always bad."""
    r = random.Random(1)
    filler = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(8000):
        a, b = r.random() < share, r.random() < share
        one = max(0.2 - share, 0) / (1 - share)
        bad = r.random() < (1 if a and b else one if a or b else 0.2)
        rows.append((i, " ".join(r.choices(filler, k=20) + ["insult"] * a + ["group"] * b), "s", 1, "t"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [" ".join(r.choices(filler, k=20)) for _ in range(50)]
    mean = {
        extra: toxicity.sigmoid(model.margin([model.columns(f"{t} {extra}", {}) for t in texts])).mean()
        for extra in ("", "insult", "group", "insult group")
    }
    assert mean["insult group"] > 0.6, mean
    assert max(mean[""], mean["insult"], mean["group"]) < 0.3, mean


def test_chance_brings_in_no_pairs():
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(300) < 0.1) for _ in range(3000)]
    y = (r.random(3000) < 0.1).astype(float)
    assert toxicity.pair_terms(rows, y, np.full(3000, 0.1), np.arange(300), 5.5, 500) == []


def test_words_of_parts(monkeypatch):
    text = " ".join(f"Wörd{i}_x" for i in range(500))
    whole = toxicity.words(text)
    monkeypatch.setattr(toxicity, "PART_CHARS", 7)
    assert toxicity.words(text) == whole and len(whole) == 500


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(docs, labels.where(~part))
    rows = toxicity.score(docs, model).join(labels.where(part), "doc_id").collect()
    clean = [r.score < 0.3 for r in rows if not r.toxic]
    toxic = [r.score >= 0.3 for r in rows if r.toxic]
    assert np.mean(clean) > 0.97 and np.mean(toxic) > 0.8


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, "s", 1, "t"), (1, "", "s", 1, "t"), (1, "", "s", 1, "t"), (2, "bad", "s", 1, "t")], DOCS)
    for rows in ([], [(2, 1)], [(None, 1), (2, None)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        found = toxicity.score(docs, model)
        assert set(found.columns) == set(docs.columns)
        assert all(0 <= r.score <= 1 for r in found.collect()) and found.count() == 4
        assert toxicity.score(docs.limit(0), model).count() == 0
