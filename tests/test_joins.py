"""Joins on hot keys and the substring join, against brute force."""

import random
import time

import pytest
from conftest import plan_of, rows_of

from chatlens import storage
from chatlens.operators import joins, routing


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_lookup_equals_plain_join(spark, how):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 5}", i) for i in range(500)], "k string, v int")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("none", 4)], "k string, w int")
    plain = big.join(lookup, "k", how)
    stored = joins.lookup_join(big, lookup, ["k"], how, max_rows=0)
    assert stored.columns == plain.columns
    assert rows_of(stored) == rows_of(plain)
    assert rows_of(joins.lookup_join(big, lookup, ["k"], how)) == rows_of(plain)


def test_only_measured_tables_are_broadcast(spark):
    big = spark.range(1000)
    lookup = spark.range(100)
    assert "BroadcastHashJoin" in plan_of(joins.lookup_join(big, lookup, ["id"]))
    assert joins.fits_broadcast(lookup, max_rows=100)
    assert not joins.fits_broadcast(lookup, max_rows=99)
    assert not joins.fits_broadcast(lookup, max_bytes=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(joins.lookup_join(big, lookup, ["id"], max_rows=99))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_is_split(spark):
    big = spark.range(300000).selectExpr("if(id % 3 = 0, 'hot', 'k' || id % 999) AS k", "id").repartition(8)
    lookup = big.select("k").distinct().withColumn("w", big["k"])
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = joins.lookup_join(big, lookup, ["k"], "left", max_rows=0)
        assert joined.toPandas().shape[0] == 300000
        assert "skew=true" in plan_of(joined) and "Generate" not in plan_of(joined)
    finally:
        for key in small:
            spark.conf.unset(key)


@pytest.mark.parametrize("block", [1, 5, 256])
def test_contains_join(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    rng = random.Random(5)
    alphabet = "abé😀 "
    texts = [("".join(rng.choices(alphabet, k=rng.randint(0, 30))),) for _ in range(60)]
    texts = [(i, t) for i, (t,) in enumerate(texts)]
    needles = {"".join(rng.choices(alphabet, k=rng.randint(0, 4))) for _ in range(40)} | {""}
    found = joins.contains_join(
        spark.createDataFrame(texts, "id int, t string"), "id", "t",
        spark.createDataFrame([(n,) for n in needles] * 2, "needle string"), "needle",
    )
    expected = [(i, n) for i, t in texts for n in needles if n in t]
    assert rows_of(found) == sorted(expected, key=repr)


def test_words_that_share_short_grams(spark, monkeypatch):
    """The rows that are compared are about as many as the pairs found, however many words share six letters."""
    kept = {}

    def keep(df, name):
        kept[name] = stored = storage.keep(df, name)
        return stored

    monkeypatch.setattr(joins, "keep", keep)
    monkeypatch.setattr(joins, "MANY_LONG", 100, raising=False)
    monkeypatch.setattr(joins, "SAMPLE", 1)
    rng = random.Random(6)
    parts = ["tion", "there", "and", "ing"]
    word = lambda least, most: "".join(rng.choices(parts, k=rng.randint(least, most)))
    needles = sorted({word(4, 6) for _ in range(600)}) + ["there", "é" * 300]
    texts = [(i, " ".join(word(1, 6) for _ in range(30))) for i in range(40)] + [(40, None), (41, "é" * 301)]
    found = joins.contains_join(
        spark.createDataFrame(texts, "id int, t string"), "id", "t",
        spark.createDataFrame([(n,) for n in needles], "needle string"), "needle",
    )
    expected = [(i, n) for i, t in texts for n in needles if t and n in t]
    assert rows_of(found) == sorted(expected, key=repr)
    occurrences = sum(t.startswith(n, at) for _, t in texts if t for n in needles for at in range(len(t)))
    assert kept["met"].count() < 4 * occurrences


def test_places_of_a_long_block_take_linear_time(spark, monkeypatch):
    """A place takes no walk from the beginning of its block."""
    monkeypatch.setattr(joins, "BLOCK", 300_000)
    long = "xy" * 100_000 + "é😀"
    texts = spark.createDataFrame([(i, f"{i}{long}{long[:50]}needle") for i in range(4)], "id int, t string")
    needles = spark.createDataFrame([("needle",), ("é😀x",), ("none",)], "needle string")
    start = time.perf_counter()
    found = rows_of(joins.contains_join(texts, "id", "t", needles, "needle"))
    assert time.perf_counter() - start < 40
    assert found == sorted([(i, n) for i in range(4) for n in ("needle", "é😀x")], key=repr)


def test_last_lookup_row_wins(spark):
    info = spark.createDataFrame(
        [(0, "a", "old"), (1, "a", "new"), (2, "b", "mums"), (3, "b", None), (4, "c", "X"), (5, None, "zz")],
        "idx int, gus_id string, group_nature string",
    )
    chats = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "Source string, n int")
    assert rows_of(routing.route_chats(chats, info)) == [("a", 1, "new")]
    named = chats.selectExpr("Source", "n", "concat(Source, '.csv') AS file_name")
    assert routing.route_chats(named, info).count() == 1
    assert rows_of(routing.distinct_natures(info)) == [("X",), ("mums",), ("new",), ("old",), ("zz",)]
