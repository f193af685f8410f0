"""Removal of repeated byte strings against a dictionary of all windows."""

import random
from collections import Counter

import pytest

from chatlens.llm import suffix_dedup

DOCS = "doc_id long, text string, kept string, rank long, name string, data int"


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def check(spark, rows, size, gram):
    docs = spark.createDataFrame([(i, t, "k", 1, "n", 2) for i, t in rows], DOCS).repartition(3)
    got = suffix_dedup.remove_repeats(docs, size, gram)
    assert got.columns == ["doc_id", "text", "rank", "name", "data", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted(
        ((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()),
        key=str,
    )
    expected = brute([t for _, t in rows], size)
    assert got == sorted(((i, t, *e) for (i, t), e in zip(rows, expected)), key=str)
    return sum(e[1] for e in expected)


def collection(seed, size):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    long = lambda n: " ".join(word() for _ in range(n))
    base = [long(r.randint(5, 120)) for _ in range(14)]
    passage = long(size)
    texts = list(base)
    for b in base:
        kind = r.randint(0, 4)
        if kind == 0:
            texts.append(b)
        elif kind == 1:
            at = r.randrange(len(b))
            texts.append(b[:at] + "X" + b[at + 1 :])
        elif kind == 2:
            at = r.randrange(len(b))
            texts.append(b[at:] + long(4))
        elif kind == 3:
            texts.append(long(3) + passage[r.randrange(20) :] + long(2))
    texts += [passage[: size + k] for k in range(4)] + ["ab" * size, "a" * (2 * size), None, "", "short"]
    texts += [passage[5 : 5 + size - 1], "zz" + passage[5 : 5 + size]]
    return [(i if i % 5 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, size, gram", [(1, 60, 15), (2, 40, 20), (3, 100, 25)])
def test_matches_brute_force(spark, seed, size, gram):
    assert check(spark, collection(seed, size), size, gram)


def test_repeated_rows_and_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    rows = collection(4, 50) + [(77, "abc def " * 3 + "q" * 60 + "xyz")] * 2 + [(77, "other " * 30)]
    assert check(spark, rows, 50, 12)


def test_threshold_of_the_query(spark):
    rows = collection(6, 400)
    assert check(spark, rows, 400, 100)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeats(docs).count() == 0
