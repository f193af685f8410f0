"""Every stage of the pipeline against what it must do to its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from chatlens import storage
from chatlens.llm import simhash
from test_line_dedup import brute as plain_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = storage.keep(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        kept[name] = (docs, after)
        docs = after
    before, after = kept["quality_rules"]
    assert 0 < after.count() < before.count()
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}

    before, after = kept["line_dedup"]
    expected = {i: t for i, _, _, t in plain_lines([(r.doc_id, r.text) for r in before.collect()], 10)}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = kept["simhash_near_dedup"]
    found = simhash.near_duplicates(before).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in found}
    assert after.count() == len({r.component_id for r in found})

    before, after = kept["secret_scans"]
    old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    changed = [i for i in old if old[i] != new[i]]
    assert changed == [i for i in old if 'token = "' in old[i] and "[SECRET]" in new[i]]

    before, after = kept["best_fit_packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(new)


def test_run_and_entries(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")] == [n for n in names if n.startswith("op")]


SECRET = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"


@pytest.fixture
def own_columns(spark):
    """Documents with columns named like what the operators add, null ids and texts, and repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_lines")
    extra = spark.createDataFrame(
        [(None, f"a token {SECRET} alone\nnext"), (900_001, None), (900_002, ""), (900_003, "same here"), (900_003, "same here")],
        "doc_id long, text string",
    )
    rows = docs.unionByName(extra, allowMissingColumns=True)
    return rows.withColumns(
        {
            "n_lines": F.lit("mine"), "findings": F.lit("my own"), "n_candidates": F.lit(-5), "n_dropped": F.lit(1.5),
            "_secret_cut": F.lit("x"), "kept": F.lit("y"), "fingerprint": F.lit("z"), "n_words": F.lit(0), "bucket": F.lit(0),
        }
    )


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_leave_other_columns_alone(spark, own_columns, name, stage):
    after = storage.keep(stage(spark, own_columns, SF), "stage")
    assert after.schema == own_columns.schema or after.columns == own_columns.columns
    changed = [c for c in own_columns.columns if c not in ("text", "n_chars")]
    assert after.select(*changed).exceptAll(own_columns.select(*changed)).isEmpty()
    if name in ("line_dedup", "secret_scans"):
        assert after.count() == own_columns.count()
    if name == "secret_scans":
        everything = " ".join(str(v) for r in after.collect() for v in r)
        assert SECRET not in everything and "[SECRET] alone" in everything


def test_stages_of_empty_tables(spark, own_columns):
    docs = own_columns.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.keep(stage(spark, docs, SF), name)
        assert docs.isEmpty()
