"""Importance resampling against a plain sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import rows_of, sf
from pyspark.sql import functions as F

from chatlens.llm import resampling

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def buckets(text, max_words, n):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + k]) for k in range(1, max_words + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % n for r in runs]


def brute(docs, target, percent=10, max_words=1, n=10_000, seed=2024, min_words=20):
    ours = [(i, *buckets(t, max_words, n)) for i, t in docs]
    s = Counter(b for _, _, found in ours for b in found)
    t = Counter(b for text in target for b in buckets(text, max_words, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n)))) for b in range(n)]
    rows = []
    for i, words, found in ours:
        key = f"{seed}:{'' if i is None else i}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    order = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    left = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return [(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in left.elements()]


def frames(spark, docs, target):
    return (
        spark.createDataFrame(docs, SCHEMA),
        spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"),
    )


@pytest.mark.parametrize("options", [{}, {"percent": 60, "max_words": 2, "n": 97, "min_words": 3}])
def test_matches_a_plain_sort(spark, options):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf('0.001')}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf('0.001')}/benchmark.parquet").collect()]
    own = {("buckets" if k == "n" else k): v for k, v in options.items()}
    found = resampling.resample(*frames(spark, docs, target), **own)
    assert rows_of(found) == sorted(brute(docs, target, **options), key=repr)


@pytest.mark.parametrize("segments", [1, 7, 40])
def test_ties_repeated_rows_and_nulls_keep_segments_even(spark, segments):
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(7, text)] * 300 + [(None, text)] * 20 + [(i, text) for i in range(100, 400)] + [(1, "few words"), (2, None), (3, ""), (4, "É" * 50)]
    target = ["w1 w2 w3 É", None]
    given, wanted = frames(spark, docs, target)
    found = resampling.resample(given.repartition(6), wanted, percent=50, segments=segments)
    assert rows_of(found) == sorted(brute(docs, target, percent=50), key=repr)
    scored = given.withColumn("score", F.lit(1)).withColumn("eligible", F.lit(True)).drop("text")
    runs = resampling.sorted_runs(scored.repartition(6))
    cuts = resampling.splitters(runs, len(docs), 6, segments)
    sizes = resampling.with_segment(runs, cuts).groupBy("segment").count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * -(-len(docs) // segments) + 6


def test_empty_tables_long_texts_and_other_columns(spark):
    long = " ".join(["Word", "tail"] * 300_000)
    docs = [(1, long), (2, long[: 1 << 20]), (3, "x " * 30)]
    given, wanted = frames(spark, docs, ["word"])
    more = given.withColumns({c: F.lit("x") for c in ("rank", "score", "segment", "run", "place", "weight")})
    expected = sorted(brute(docs, ["word"], percent=50), key=repr)
    assert rows_of(resampling.resample(more, wanted, percent=50)) == expected
    assert resampling.resample(given.limit(0), wanted).collect() == []
    assert rows_of(resampling.resample(given, wanted.limit(0), percent=50)) == sorted(brute(docs, [], percent=50), key=repr)
    with pytest.raises(TypeError, match="integer"):
        resampling.resample(given.withColumn("doc_id", F.lit("a")), wanted).collect()


def test_parts_of_long_texts_have_the_same_features():
    text = "one two three four five six " * 9
    whole = [x for a in resampling.feature_buckets(text, 3, 1000) for x in a.tolist()]
    parts = [x for a in resampling.feature_buckets(text, 3, 1000, part_bytes=10) for x in a.tolist()]
    assert whole == parts == buckets(text, 3, 1000)[1]
