"""Every query against its SQL, and the counts that were fixed before the engine existed."""

import pytest
from conftest import rows_of, sf
from pyspark.sql import functions as F

import __spark_entry__
from checks.compare import difference, open_tables
from checks.oracle import ORACLE
from checks.queries import QUERIES
from chatlens import fixtures as fx
from chatlens.operators import tagging
from chatlens.plans import flows
from chatlens.sinks import files as sinks

HEADERS = [
    "thal_one", "thal_two", "thal_generic", "enor_pro", "enor_max", "enor_lite",
    "enor_generic", "solo_generic", "thalia_one",
]


@pytest.fixture(scope="module")
def tables():
    return open_tables(sf("0.001"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, tables, name):
    assert difference(spark, tables, name, sf("0.001")) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[11:] == HEADERS
    assert df.count() > 0


def _counts(df):
    counts = dict(df.groupBy("header").count().collect())
    return [counts.get(h, 0) for h in HEADERS]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("tag_required_any", [85, 207, 57, 5, 15, 6, 5, 26, 10]),
        ("tag_required_literal", [1, 207, 57, 3, 15, 6, 5, 26, 10]),
        ("tag_generic", [85, 207, 14, 5, 15, 6, 2, 26, 10]),
        ("tag_documents", [385, 635, 9, 94, 104, 96, 2, 82, 57]),
    ],
)
def test_hit_counts(spark, name, expected):
    assert _counts(QUERIES[name](spark, sf("0.01"))) == expected


def test_score_counts(spark):
    scores = QUERIES["lexicon_scores"](spark, sf("0.01")).groupBy("sentiment").count()
    assert dict(scores.collect()) == {"P": 60, "N": 62, "I": 248}


def test_route_counts(spark):
    routed = QUERIES["route_chats"](spark, sf("0.01")).groupBy("nature").count()
    assert dict(routed.collect()) == {"mums": 182, "deals": 83}


def test_merge_counts(spark):
    assert QUERIES["union_exports"](spark, sf("0.01")).count() == 680
    merged = QUERIES["merge_dedupe"](spark, sf("0.01"))
    assert merged.count() == 536
    assert dict(merged.groupBy("Source").count().collect()) == {
        "grp0": 90, "grp1": 92, "grp2": 83, "grp3": 101, "grp4": 72, "grp5": 98,
    }


def test_orders_differ(spark):
    chrono = rows_of(QUERIES["merge_seq_chrono"](spark, sf("0.01")))
    lexical = rows_of(QUERIES["merge_seq_lexical"](spark, sf("0.01")))
    place = {r[:4]: r[4] for r in lexical}
    assert sum(place[r[:4]] != r[4] for r in chrono) == 532


def test_result_does_not_depend_on_partitioning(spark):
    folder = sf("0.001")
    expected = rows_of(QUERIES["final_table"](spark, folder))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(QUERIES["final_table"](spark, folder)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_merge_is_idempotent(spark):
    from chatlens.plans import flows

    merged = QUERIES["merge_dedupe"](spark, sf("0.001"))
    again = flows.merge_exports([merged, merged.select(*reversed(merged.columns))])
    assert rows_of(again.select(*merged.columns)) == rows_of(merged)


def test_hits_of_final_table_are_distinct_cells(spark):
    wide = QUERIES["tag_wide"](spark, sf("0.01"))
    both = wide.where(
        (F.col("thal_generic") == 1)
        & ((F.col("thal_one") == 1) | (F.col("thal_two") == 1) | (F.col("thalia_one") == 1))
    )
    assert wide.count() == 536
    assert both.count() == 0


def test_final_table_as_cells(spark):
    """The map of cells read back by name is the wide table."""
    folder = sf("0.001")
    wide = QUERIES["final_table"](spark, folder)
    run = flows.run(
        fx.export_slices(spark, folder), fx.group_info(spark), fx.rules(spark),
        positive=fx.POSITIVE, negative=fx.NEGATIVE, as_cells=True,
    )
    headers = tagging.header_names(flows.prepare_rules(fx.rules(spark)))
    cells = sinks.read_cells(run.drop("sheet"), headers)
    assert cells.columns == wide.columns and headers
    assert sorted(map(str, cells.collect())) == sorted(map(str, wide.collect()))
