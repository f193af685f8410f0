"""CSV files read in blocks, and trees of many headers."""

import csv
import io
import itertools
import os

import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from test_files import put

from chatlens.sources import csv_files
from chatlens.sources.csv_files import cut_record, stays_open

PIECES = st.lists(st.sampled_from(['"', '""', ",", "a", " ", '",', ',"']), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_records_are_those_of_a_plain_reader(lines):
    text = "\n".join(lines)
    records, begun = [], []
    for line in lines:
        begun.append(line)
        if not stays_open(line, len(begun) > 1):
            records.append(cut_record("\n".join(begun)))
            begun = []
    expected = list(csv.reader(io.StringIO(text), strict=False))
    expected = [r or [""] for r in expected]
    if begun:  # the plain reader closes an open quote at the end
        expected = expected[: len(records)]
    if text.endswith("\n") or not text:
        expected += [[""]] * (len(records) - len(expected))
    assert records == expected


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    bodies = [
        f"{k}: " + ("line\n" * (k % 40)) + ('say "so", ' * (k % 3)) + ("x" * 900 if k % 50 == 7 else "") + "\r\n, end"
        for k in range(300)
    ]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(["n", "body"])
    writer.writerows([k, b] for k, b in enumerate(bodies))
    put(tmp_path, "one.csv", out.getvalue())
    put(tmp_path, "plain.csv", "n,body\n" + "".join(f"{k},plain {k}\n" for k in range(300)))
    lines = csv_files._lines(spark, str(tmp_path), True)
    assert lines.rdd.getNumPartitions() > 30
    rows = csv_files.scan_csv(spark, str(tmp_path), positions=True)
    found = rows.select("file_name", "_pos", "n", "body").orderBy("file_name", "_pos").collect()
    expected = [("one.csv", k, str(k), b) for k, b in enumerate(bodies)]
    expected += [("plain.csv", k, str(k), f"plain {k}") for k in range(300)]
    assert [tuple(r) for r in found] == expected


def test_a_quote_open_over_blocks_spoils_its_file_only(spark, tmp_path, small_blocks):
    rows = "".join(f"{k},text {k}\n" for k in range(200))
    put(tmp_path, "open.csv", "n,body\n" + rows + '7,"never closed\n' + rows)
    put(tmp_path, "good.csv", "n,body\n" + rows)
    put(tmp_path, "long.csv", "n,body\n" + rows + "1,2,3\n" + rows)
    bad = {os.path.basename(r["path"]): r["fault"] for r in csv_files.bad_records(spark, str(tmp_path)).collect()}
    assert bad == {"open.csv": csv_files.OPEN_QUOTE, "long.csv": csv_files.TOO_LONG}
    with pytest.warns(UserWarning, match="skipped 2"):
        assert csv_files.scan_csv(spark, str(tmp_path)).count() == 200


def test_headers_with_line_breaks_and_lines_of_blanks(spark, tmp_path):
    put(tmp_path, "a.csv", '﻿\n  \nx,"y\nz",w\r\n1,2,3\r\n \t \r\n\r\n4,"5\n\n6",\r\n')
    put(tmp_path, "b.csv", "w,x\n\n   \n7,8\n")
    put(tmp_path, "blank.csv", "\n  \n")
    rows = csv_files.scan_csv(spark, str(tmp_path))
    assert rows.columns == ["w", "x", "y\nz", "path", "file_name"]
    assert rows_of(rows.select("x", "`y\nz`", "w")) == [("1", "2", "3"), ("4", "5\n\n6", None), ("8", None, "7")]


def test_thousands_of_headers(spark, tmp_path):
    names = ["Date2", "Time", "userPhone", "messageBody", "a", "b", "c"]
    for k, order in enumerate(itertools.permutations(names)):
        if k == 5000:
            break
        put(tmp_path, f"{k % 50}/{k}.csv", f"{','.join(order)}\n{','.join(f'{n} {k}' for n in order)}\n")
    rows = csv_files.scan_csv(spark, str(tmp_path))
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 20_000
    found = rows_of(rows.select(*names))
    assert found == sorted((tuple(f"{n} {k}" for n in names) for k in range(5000)), key=repr)
