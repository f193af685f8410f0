"""Bottom-k sketches against sets of shingles."""

import hashlib
import random

import numpy as np
import pytest

from chatlens.llm import fingerprints as fp

DOCS = "doc_id long, text string, lang string, sketch string, range string, ahead int"


def grams(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", 1) for i, t in rows], DOCS).repartition(3)


def test_small_texts_are_exact():
    r = random.Random(1)
    texts = [" ".join(r.choices("abcdef", k=r.randint(0, 60))) for _ in range(40)]
    for a in texts:
        for b in texts[:10]:
            x, y = grams(a), grams(b)
            assert fp.resemblance(fp.sketch(a), fp.sketch(b)) == (
                pytest.approx(len(x & y) / len(x | y)) if x | y else 1.0
            )
            assert fp.containment(fp.sketch(a), fp.sketch(b)) == (
                pytest.approx(len(x & y) / len(x)) if x else 1.0
            )
        assert fp.distinct_count(fp.sketch(a)) == len(grams(a))
        assert (fp.from_text(fp.as_text(fp.sketch(a))) == fp.sketch(a)).all()


def test_large_texts_are_estimated():
    words = [f"w{i}" for i in range(20000)]
    a, b = " ".join(words[:15000]), " ".join(words[5000:])
    x, y = fp.sketch(a), fp.sketch(b)
    assert fp.resemblance(x, y) == pytest.approx(0.5, abs=0.15)
    assert fp.containment(x, y) == pytest.approx(2 / 3, abs=0.2)
    assert fp.distinct_count(x) == pytest.approx(15000, rel=0.3)


def test_merge(spark):
    parts = [(1, "a b c d e f g"), (1, "x y z u v w"), (2, "a b"), (3, ""), (1, None)]
    rows = fp.sketches(table(spark, parts), k=4)
    got = {r.doc_id: r.sketch for r in fp.merge_parts(rows, "doc_id", k=4).collect()}
    both = np.union1d(fp.sketch(parts[0][1]), fp.sketch(parts[1][1]))[:4].tolist()
    assert got == {1: both, 2: fp.sketch("a b").tolist(), 3: []}
    pair = rows.where("doc_id = 1 and text is not null").selectExpr("max(sketch) a", "min(sketch) b")
    assert pair.select(fp.merged(pair.a, pair.b, 4)).head()[0] == both


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    out = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        s, u, v = fp.sketch(t), fp.sketch(e), fp.sketch(n)
        out.append(
            (i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(s), fp.as_text(u),
             fp.resemblance(s, u), fp.resemblance(s, v))
        )
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "ids",
    [
        list(range(-50, 250)),
        [7],
        [None],
        [None, None, 3],
        [None, None, None],
        [5, 5, 5, 6, 6, 9],
        [1] * 40 + [2],
        [],
    ],
)
def test_next_document(spark, ids):
    r = random.Random(len(ids))
    words = ["ä", "bb", "ccc", "D\n", "日本"]
    rows = [(i, r.choice(["", None, " ".join(r.choices(words, k=r.randint(1, 90)))])) for i in ids]
    got = fp.compare_with_edited(table(spark, rows)).collect() if rows else []
    assert sorted((tuple(x) for x in got), key=str) == expected(rows)


def test_empty_table(spark):
    assert fp.compare_with_edited(spark.createDataFrame([], DOCS)).count() == 0


def test_next_document_of_wide_ids_and_nulls(spark):
    """Ids that float64 cannot tell apart, in batches with nulls."""
    r = random.Random(5)
    ids = [2**62 + 3 * i for i in range(200)] + [-(2**62) - i for i in range(50)] + [None] * 5
    rows = [(i, " ".join(r.choices(["a", "bb", "ccc", "dd"], k=r.randint(1, 30)))) for i in ids]
    r.shuffle(rows)
    got = fp.compare_with_edited(table(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(rows)


@pytest.mark.parametrize("part_bytes", [1, 2, 4, 7, 12, 30])
def test_shingles_of_small_parts(part_bytes):
    """Parts of fewer words than the overlap lose none."""
    for text in (b"a b <huge> c d e f g", b"a b c d e f g h i j k", b"a bb ccc dddd", b" a  b\nc d e "):
        w = text.split()
        runs = [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or [b" ".join(w)]
        got = np.concatenate(list(fp.shingle_hashes(text, 5, part_bytes=part_bytes)))
        assert got.tolist() == np.concatenate([list(fp.shingle_hashes(x, 5))[0] for x in runs]).tolist()
