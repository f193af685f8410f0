"""MinHash near-dedup against all pairs of sets."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of, sf
from pyspark.sql import functions as F

from chatlens.llm import minhash

SCHEMA = "doc_id long, text string"


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)) if words)


def brute(rows, size, percent=80):
    """Number of shingles and smallest id of the component, by id."""
    sets = {i: shingles(t, size) for i, t in rows}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        common = Counter(j for s in own for j in holders[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    return [(i, len(sets[i]), root(i), root(i) == i) for i in sorted(sets)]


def family(n, words, edits, seed):
    """Texts of ``words`` words that each differ from one base in some places."""
    random = np.random.default_rng(seed)
    base = [f"w{x}" for x in random.integers(0, 5000, words)]
    for k in range(n):
        own = list(base)
        for at in random.integers(0, words, edits):
            own[at] = f"e{k}x{at}"
        yield " ".join(own)


def test_signature_is_the_lowest_rank_over_shifted_places():
    found = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    place, rank = minhash.permutations(8)
    assert sorted(place.tolist()) == list(range(minhash.UNIVERSE))
    rank = rank[: minhash.UNIVERSE]
    at = place[(found % np.uint64(minhash.UNIVERSE)).astype(int)].astype(int)
    assert minhash.signature(found, 8).tolist() == [rank[(at + k) % minhash.UNIVERSE].min() for k in range(8)]


def test_estimates_similarity():
    random = np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = minhash.signature(random[:2000], 1024), minhash.signature(random[1000:], 1024)
    assert (a == b).mean() == pytest.approx(1 / 3, abs=0.06)


@pytest.mark.parametrize("limits", [{}, {"large": 4, "block_shingles": 300}])
def test_matches_all_pairs(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(minhash, "SMALL", 3)
    texts = [
        *family(25, 60, 2, 1),  # near the limit: some pairs link, others do not
        *family(25, 60, 4, 2),  # related, seldom similar enough
        *family(6, 200, 1, 3),
        *[f"{' '.join(f'p{i}' for i in range(40))} {' '.join(f'own{k}a{i}' for i in range(30))}" for k in range(20)],
        "one two three four five", "ONE two\tthree  four\nfive", "one two", "One Two", "one", "", " \n ", None, None,
    ]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4, **limits)
    assert rows_of(found) == sorted(brute(rows, 4), key=repr)


def test_matches_all_pairs_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{sf('0.001')}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(minhash.near_duplicates(docs, shingle=5)) == sorted(brute(rows, 5), key=repr)


def test_null_ids_repeated_rows_long_texts_and_other_columns(spark):
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [
        (None, "a b c d e f g h"), (9, "a b c d e f g h"), (9, "a b c d e f g h"), (None, "alone in the world"),
        (4, long), (5, long.replace("word77 ", "other ")), (6, None), (6, ""),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("root", "rep", "set_key", "component_id", "n_shingles", "bucket")}
    )
    assert rows_of(minhash.near_duplicates(docs, shingle=4)) == sorted(
        [
            (None, 5, 9, False), (9, 5, 9, True), (9, 5, 9, True), (None, 1, None, True),
            (4, 199_997, 4, True), (5, 199_997, 4, False), (6, 0, 6, True), (6, 0, 6, True),
        ],
        key=repr,
    )
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_a_hot_group_of_copies_is_one_set(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text for a third of all")).otherwise(
            F.concat_ws(" ", *[F.xxhash64("id", F.lit(k)).cast("string") for k in range(9)])
        ).alias("text"),
    )
    found = minhash.near_duplicates(rows, shingle=4).where("component_id <> doc_id")
    assert found.agg(F.count("*"), F.max("component_id")).first()[:] == (999, 0)
