"""Counts against plain loops, trees against node-by-node descent, and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import boosting, common, quality

DOCS = "doc_id long, text string, kept string, n_words string, label int"
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


TEXTS = ["", " ", "a", "a b", "a b c", "a b c a b c", "x\nx\n x\nx", "#é*\xa0$ %&|<> \u3000", "aé\x1cb \x85 c"] + [
    " ".join(random.Random(i).choices(["a", "b", "cc", "d\n", "é|"], k=i)) for i in range(0, 120, 7)
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality.statistics(text)[:5] == plain_counts(text)


def test_counts_of_parts(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(4000))
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "word_parts", lambda d, k: common.word_parts(d, k, 64))
    assert quality.statistics(text) == whole


def descend(model, row):
    inner = model.feature.shape[1]
    total = model.bias
    for t in range(len(model.feature)):
        k = 0
        while k < inner:
            k = 2 * k + 1 + int(row[model.feature[t, k]] > model.threshold[t, k])
        total += model.value[t, k - inner]
    return 1 / (1 + np.exp(-total))


def test_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + r.normal(0, 0.3, 800)) > 0).astype(float)
    model = boosting.fit(x, y, [1, 0, 0, -1], trees=40)
    p = model.score(x)
    assert ((p > 0.5) == y).mean() > 0.85
    assert p[:20] == pytest.approx([descend(model, row) for row in x[:20]])
    base = r.normal(size=(50, 4))
    for column, sign in ((0, 1), (3, -1)):
        steps = []
        for v in np.linspace(-3, 3, 25):
            moved = base.copy()
            moved[:, column] = v
            steps.append(model.score(moved))
        assert (sign * np.diff(np.stack(steps), axis=0) >= -1e-12).all()


def test_trees_without_labels():
    assert boosting.fit(np.empty((0, 3)), np.empty(0), [0, 0, 0]).score(np.zeros((2, 3))) == pytest.approx(0.5)
    assert boosting.fit(np.zeros((3, 1)), np.ones(3), [0]).score(np.zeros((1, 1)))[0] > 0.99


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~part))
    rows = quality.assess(docs, model).join(labels.where(part), "doc_id").collect()
    right = [(r.quality_score >= 0.5) == bool(r.quality) for r in rows]
    assert np.mean(right) > 0.95
    assert all(r.kept == (not r.base_failed and r.quality_score >= 0.5) for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 0 for r in rows)


def test_odd_tables(spark):
    rows = [(None, None, "k", "w", 1), (1, "", "k", "w", 1), (2, "word " * 80, "k", "w", 1), (2, "word " * 80, "k", "w", 1)]
    rows.append((3, " ".join(f"w{i}" for i in range(60)), "k", "w", 1))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(None, 1), (9, 0), (3, None)], "doc_id long, quality int")
    found = quality.assess(docs, quality.train(docs, labels))
    assert found.columns[:3] == ["doc_id", "text", "label"]
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in found.collect()), key=str)
    assert got == sorted(
        [(None, 0, True, False), (1, 0, True, False), (2, 80, True, False), (2, 80, True, False), (3, 60, False, True)],
        key=str,
    )
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    assert quality.good_documents(docs.limit(0), labels).count() == 0
