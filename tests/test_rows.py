"""Duplicates, order and numbering, also with one chat holding most rows."""

import datetime as dt

import pytest
from conftest import plan_of, rows_of

from chatlens.operators import rows
from chatlens.operators.validation import check_chats, null_violations
from chatlens.schemas import SchemaError

SCHEMA = "Source string, Date2 string, Time string, messageBody string"


def chronological(row):
    _, date, time, _ = row
    try:
        day = dt.datetime.strptime(date or "", "%d/%m/%Y")
    except ValueError:
        day = None
    try:
        clock = dt.datetime.strptime(time or "", "%H:%M:%S")
    except ValueError:
        clock = None
    return (day is None, day or 0, clock is None, clock or 0)


def test_day_first_order_with_unreadable_dates_last(spark):
    dates = ["x", "01/02/2024", "02/01/2024", "2024-02-03", None]
    chats = spark.createDataFrame([("c", d, "10:00:00", "") for d in dates], SCHEMA)
    numbered = rows.number_rows(chats)
    assert [r["Date2"] for r in numbered.orderBy("seq").collect()] == [
        "02/01/2024", "01/02/2024", "2024-02-03", "x", None,
    ]
    lexical = rows.number_rows(chats, rows.LEXICAL).orderBy("seq").collect()
    assert [r["Date2"] for r in lexical] == [
        "01/02/2024", "02/01/2024", "2024-02-03", "x", None,
    ]
    with pytest.raises(ValueError):
        rows.order_columns(chats, "random")


def test_times(spark):
    times = ["9:05:01", "10:00:00", "25:00:00", "noon", None, "00:00:00"]
    chats = spark.createDataFrame([("c", "01/02/2024", t, "") for t in times], SCHEMA)
    found = [r["Time"] for r in rows.number_rows(chats).orderBy("seq").collect()]
    assert found == ["00:00:00", "9:05:01", "10:00:00", "25:00:00", "noon", None]


def test_numbering_cuts_a_hot_chat(spark):
    raw = [
        (
            "hot" if i % 3 else f"c{i % 7}",
            None if i % 2 else f"{1 + i % 28:02d}/{1 + i % 12:02d}/2024",
            "bad" if i % 2 else f"{i % 24:02d}:{i % 60:02d}:00",
            f"{i:05d}",
        )
        for i in range(6000)
    ]
    chats = spark.createDataFrame(raw, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = rows.sort_chats(chats)
        sizes = ordered.rdd.glom().map(len).collect()
        assert max(sizes) < 2000
        numbered = rows_of(rows.number_rows(chats))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for source in {r[0] for r in raw}:
        mine = [r for r in raw if r[0] == source]
        mine.sort(key=lambda r: (chronological(r), r[3]))
        expected += [(*r, i + 1) for i, r in enumerate(mine)]
    assert numbered == sorted(expected, key=repr)


def test_duplicates_with_nulls(spark):
    chats = spark.createDataFrame(
        [("c", None, "1", "x"), ("c", None, "1", "x"), ("c", "", "1", "x"), ("d", None, "1", "x")],
        SCHEMA,
    )
    found = rows.drop_duplicate_rows(chats)
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    assert rows_of(found) == sorted(
        [("c", None, "1", "x"), ("c", "", "1", "x"), ("d", None, "1", "x")], key=repr
    )


def brute_distinct(raw):
    return sorted(set(raw), key=repr)


@pytest.mark.parametrize("bits", [15, 18, rows.FILTER_BITS])
def test_repeated_rows_by_hash(spark, bits):
    # a third of all rows are copies of one, some are met twice, nulls and blanks differ
    raw = [("hot", None, "1", "same")] * 2000
    raw += [("c", f"{i}", None if i % 3 else "", f"text {i}") for i in range(3000)]
    raw += [("c", f"{i}", None if i % 3 else "", f"text {i}") for i in range(0, 3000, 7)]
    chats = spark.createDataFrame(raw, SCHEMA).repartition(5)
    assert rows_of(rows.drop_repeated_rows(chats, bits)) == brute_distinct(raw)


def test_repeated_rows_of_any_columns(spark):
    raw = [(0.0, 1, 2, None), (-0.0, 1, 2, None), (float("nan"), 1, 2, "x"), (float("nan"), 1, 2, "x"), (1.5, None, 2, "x")]
    chats = spark.createDataFrame(raw, "_bits double, _hash int, `_row.a` int, _bucket string")
    found = rows.drop_repeated_rows(chats)
    assert found.columns == chats.columns
    assert repr(rows_of(found)) == repr(rows_of(chats.distinct()))
    assert found.count() == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert rows.drop_repeated_rows(empty).collect() == []
    assert rows_of(rows.drop_repeated_rows(chats.select("_hash"))) == [(1,), (None,)]


def test_unique_rows_are_not_shuffled(spark, tmp_path):
    raw = [(f"c{i % 9}", f"{i}", "1", f"text {i}") for i in range(3000)]
    spark.createDataFrame(raw + raw[:20], SCHEMA).write.parquet(str(tmp_path / "chats"))
    found = rows.drop_repeated_rows(spark.read.parquet(str(tmp_path / "chats")))
    assert found.count() == 3000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    unique = final[: final.index("HashAggregate(keys=[")]
    assert "Exchange hashpartitioning(messageBody" not in final
    assert "BroadcastHashJoin" in unique and "hashpartitioning(Source" not in unique


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", "2")], "a string, b string")
    b = spark.createDataFrame([("3", "4")], "c string, a string")
    assert rows_of(rows.union_exports([a, b])) == [("1", "2", None), ("4", None, "3")]


def test_group_files(spark):
    files = spark.createDataFrame(
        [("a.csv", "1/a.csv"), ("a.csv", "2/a.csv"), ("a.csv", "2/a.csv"), ("b.csv", "1/b.csv")],
        "file_name string, path string",
    )
    assert rows_of(rows.group_files(files)) == [
        ("a.csv", "1/a.csv", 2), ("a.csv", "2/a.csv", 2), ("b.csv", "1/b.csv", 1),
    ]


def test_validation(spark):
    with pytest.raises(SchemaError, match="Date1"):
        check_chats(spark.createDataFrame([("1",)], "Date2 string"))
    df = spark.createDataFrame([(1, None, "x"), (2, "y", None), (3, "y", "x")], "k int, a string, b string")
    assert rows_of(null_violations(df, ["a", "b"], ["k"])) == [
        (1, "a", "not_null"), (2, "b", "not_null"),
    ]
