"""CSV and lookup files with everything that goes wrong in practice."""

import csv
import gzip
import os

import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from chatlens.operators.rows import chat_rows, sort_chats
from chatlens.plans import flows
from chatlens.schemas import EXPORT_COLUMNS, SchemaError
from chatlens.sinks import files as sinks
from chatlens.sources import csv_files, lookups

HEADER = ",".join(EXPORT_COLUMNS)
BODY = 'she said ""hi"", ok\nnext\r\nlast \\ '


def put(root, path, text):
    target = root / path
    os.makedirs(target.parent, exist_ok=True)
    target.write_bytes(text.encode())


def test_merges_by_name_whatever_the_column_order(spark, tmp_path):
    put(tmp_path, "a/chat one 群.csv", "Date2,Time,userPhone,messageBody\n01/02/2024,10:00:00,00852,NA\n")
    put(
        tmp_path,
        "b/chat one 群.csv",
        "messageBody,extra,Time,Date2,userPhone\n"
        "NA,,10:00:00,01/02/2024,00852\n"
        f'" {BODY}",x,11:00:00,01/02/2024,007\n',
    )
    put(tmp_path, "b/[odd] {name}*?+%20.csv", "Date2,Time,messageBody\n02/01/2024,09:00:00,hi\n")
    put(tmp_path, "b/empty.csv", "")
    put(tmp_path, "b/header only.csv", "Date2,Time,other\n")
    exports = csv_files.scan_exports(spark, str(tmp_path))
    merged = flows.merge_exports([exports])
    assert rows_of(merged.select("Source", "Date2", "Time", "userPhone", "messageBody", "extra")) == [
        ("[odd] {name}*?+%20", "02/01/2024", "09:00:00", None, "hi", None),
        ("chat one 群", "01/02/2024", "10:00:00", "00852", "NA", None),
        ("chat one 群", "01/02/2024", "11:00:00", "007", " " + BODY.replace('""', '"'), "x"),
    ]


def test_short_rows_are_filled_and_long_rows_spoil_their_file(spark, tmp_path):
    put(tmp_path, "good.csv", "a,b,c\n1,2\n\"x,y\",\"q\"\"r\",\"s\nt\"\n")
    put(tmp_path, "long.csv", "a,b,c\n1,2,3\n1,2,3,4\n")
    put(tmp_path, "blank end.csv", "a,b,c\n1,2,3,\n")
    with pytest.warns(UserWarning, match="skipped 1"):
        rows = csv_files.scan_exports(spark, str(tmp_path))
    # an empty field past the header does not shift or cost the row
    assert rows_of(rows.select("a", "b", "c")) == [
        ("1", "2", "3"), ("1", "2", None), ("x,y", 'q"r', "s\nt"),
    ]
    assert csv_files.scan_chat_csv(spark, str(tmp_path / "good.csv")).count() == 2
    bad = csv_files.bad_records(spark, str(tmp_path))
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["long.csv"]
    with pytest.raises(Exception, match="record longer than the header"):
        csv_files.scan_chat_csv(spark, str(tmp_path)).collect()


def test_unclosed_quotes_and_other_encodings_spoil_their_file(spark, tmp_path):
    put(tmp_path, "good.csv", 'a,b\n1,5" pipe\n2,"x ""y"\n3,\ufffd\n')
    put(tmp_path, "open.csv", 'a,b\n1,2\n3,"open\n5,6\n')
    put(tmp_path, "far.csv", "a,b\n1,2,,,,,9\n")
    (tmp_path / "latin.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    with pytest.warns(UserWarning, match="skipped 3"):
        rows = csv_files.scan_exports(spark, str(tmp_path))
    assert rows_of(rows.select("a", "b")) == [("1", '5" pipe'), ("2", 'x "y'), ("3", "\ufffd")]
    faults = {os.path.basename(r["path"]): r["fault"] for r in csv_files.bad_records(spark, str(tmp_path)).collect()}
    assert faults == {
        "open.csv": csv_files.OPEN_QUOTE, "far.csv": csv_files.TOO_LONG, "latin.csv": csv_files.NOT_UTF8,
    }
    for name in ("open", "latin"):
        with pytest.raises(ValueError, match="quote|UTF-8"):
            csv_files.scan_chat_csv(spark, str(tmp_path / f"{name}.csv"))


def test_names_that_differ_in_case(spark, tmp_path):
    put(tmp_path, "a.csv", "Date2,date2,path\n1,2,3\n")
    put(tmp_path, "b.csv", "DATE2,x\n4,5\n")
    rows = csv_files.scan_exports(spark, str(tmp_path))
    # headers are taken in the order of their lines
    assert rows.columns == ["DATE2", "x", "Date2.1", "date2.1.1", "path.1", "file_name", "Source"]
    assert rows_of(rows.drop("file_name")) == [
        ("4", "5", None, None, None, "b"), (None, None, "1", "2", "3", "a"),
    ]


def test_na_tokens(spark, tmp_path):
    put(tmp_path, "c.csv", "a,b\nNA,null\nx,\n")
    kept = csv_files.scan_exports(spark, str(tmp_path))
    assert rows_of(kept.select("a", "b")) == [("NA", "null"), ("x", None)]
    blanked = csv_files.scan_exports(spark, str(tmp_path), na_tokens=["NA", "null"])
    assert rows_of(blanked.select("a", "b")) == [("x", None), (None, None)]


def test_no_files(spark, tmp_path):
    put(tmp_path, "none.csv", "")
    assert csv_files.scan_exports(spark, str(tmp_path)).count() == 0


def test_missing_date_leaves_order_alone(spark, tmp_path):
    put(tmp_path, "c.csv", "Time,messageBody\n2,b\n1,a\n")
    rows = csv_files.scan_exports(spark, str(tmp_path))
    with pytest.warns(UserWarning, match="unsorted"):
        assert [r["messageBody"] for r in sort_chats(rows).collect()] == ["b", "a"]


def test_folders_are_sheets(spark, tmp_path):
    put(tmp_path, "mums/007.csv", f'{HEADER}\n,01/02/2024,10:00:00,0085,,"{BODY}",,\n')
    put(tmp_path, "mums/b.csv", f"{HEADER}\n2024,01/02/2024,10:00:00,1,q,hey,image,cap\n")
    put(tmp_path, "deals/b.csv", f"{','.join(reversed(EXPORT_COLUMNS))}\n,,x,,2,t,d,e\n")
    put(tmp_path, "deals/deep/c.csv", f"{HEADER}\n,,,,,,,\n")
    os.makedirs(tmp_path / "nothing")
    chats = flows.load_chats(spark, str(tmp_path))
    assert rows_of(chats) == [
        ("deals", "b", "", "e", "d", "t", "2", "", "x", "", "", ""),
        ("mums", "007", "", "", "01/02/2024", "10:00:00", "0085", "", BODY.replace('""', '"'), "", "", ""),
        ("mums", "b", "", "2024", "01/02/2024", "10:00:00", "1", "q", "hey", "image", "cap", ""),
    ]
    put(tmp_path, "deals/short.csv", "Date2,Time\n1,2\n")
    with pytest.raises(SchemaError, match="missing columns"):
        flows.load_chats(spark, str(tmp_path))


def test_written_chats_come_back(spark, tmp_path):
    raw = [
        ("007", "01/02/2024", "10:00:00", BODY.replace('""', '"')),
        ("a b/c=d", "x", "", "  blanks  "),
        ("群", "02/01/2024", "1", '"'),
        ("群", "02/01/2024", "2", ""),
    ]
    chats = spark.createDataFrame(raw, "Source string, Date2 string, Time string, messageBody string")
    folder = str(tmp_path / "out")
    sinks.write_merged(chats, folder)
    back = csv_files.scan_partitioned(spark, folder, ["Date2", "Time", "messageBody"], ["Source"])
    assert rows_of(back.fillna("")) == sorted(raw, key=repr)
    names = csv_files.list_chats(spark, folder)
    assert rows_of(names) == [("007", None), ("a b/c=d", None), ("群", None)]


def test_written_order_follows_file_names(spark, tmp_path):
    raw = [("c", f"{d:02d}/{m:02d}/2024", f"{d % 24:02d}:00:00", f"{m}-{d}") for m in range(1, 13) for d in range(1, 29)]
    chats = spark.createDataFrame(raw, "Source string, Date2 string, Time string, messageBody string")
    folder = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_merged(chats.repartition(5), str(folder))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((folder / "Source=c").glob("*.csv"))
    assert len(files) > 1
    bodies = [line.rsplit(",", 1)[1].strip() for f in files for line in open(f).readlines()[1:]]
    assert bodies == [r[3] for r in raw]


def test_routed_chats_are_written_in_order(spark, tmp_path):
    raw = [
        (nature, source, f"{d:02d}/{m:02d}/2024", "10:00:00", f"{m}-{d}")
        for nature, source in [("mums", "b"), ("deals", "b"), ("mums", "a"), ("zz", "a")]
        for m in range(1, 13)
        for d in range(1, 29)
    ]
    schema = "nature string, Source string, Date2 string, Time string, messageBody string"
    chats = spark.createDataFrame(raw, schema).orderBy("messageBody").repartition(6)
    folder = tmp_path / "out"
    sinks.write_by_nature(chats, str(folder))
    for nature, source in {r[:2] for r in raw}:
        files = sorted((folder / f"nature={nature}" / f"Source={source}").glob("*.csv"))
        lines = [line for f in files for line in open(f).readlines()[1:]]
        assert [x.rsplit(",", 1)[1].strip() for x in lines] == [
            r[4] for r in raw if r[:2] == (nature, source)
        ]
    back = csv_files.scan_partitioned(
        spark, str(folder), ["Date2", "Time", "messageBody"], ["nature", "Source"]
    )
    assert rows_of(back) == sorted(raw, key=repr)


def test_template_lists_every_file(spark, tmp_path):
    put(tmp_path, "a/x.csv", "h\n1\n")
    put(tmp_path, "b/x.csv", "h\n1\n")
    put(tmp_path, "b/y.csv.csv", "h\n1\n")
    put(tmp_path, "b/z.txt", "h\n1\n")
    assert rows_of(csv_files.list_files(spark, str(tmp_path))) == [("x", None), ("x", None), ("y", None)]


def test_lookups_keep_row_order(spark, tmp_path):
    put(tmp_path, "k.csv", "keyword,brand,product,required_product\nz,b,p,\n\"a\nb\",b,q,p\n")
    rules = lookups.scan_keywords(spark, str(tmp_path / "k.csv")).orderBy("idx")
    assert [tuple(r)[1:] for r in rules.collect()] == [("b", "p", "z", None), ("b", "q", "a\nb", "p")]
    rules.write.parquet(str(tmp_path / "k.parquet"))
    assert rows_of(lookups.scan_keywords(spark, str(tmp_path / "k.parquet"))) == rows_of(rules)
    put(tmp_path, "g.csv", "gus_id,group_nature\n007,mums\n")
    assert rows_of(lookups.scan_group_info(spark, str(tmp_path / "g.csv"))) == [(0, "007", "mums")]
    for i, n in enumerate([3, 1, 5]):
        lines = "".join(f"{i},{k}\n" for k in range(n))
        put(tmp_path, f"parts.csv/part-{i}.csv", "gus_id,group_nature\n" + lines)
        part = spark.createDataFrame([(f"{i}", f"{k}") for k in range(n)], "gus_id string, group_nature string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"p/{i}"))
    os.makedirs(tmp_path / "parts.parquet")
    for i in range(3):
        (file,) = (tmp_path / f"p/{i}").glob("*.parquet")
        file.rename(tmp_path / f"parts.parquet/part-{i}.parquet")
    expected = [(n, str(i), str(k)) for n, (i, k) in enumerate((i, k) for i, m in enumerate([3, 1, 5]) for k in range(m))]
    for kind in ("csv", "parquet"):
        assert rows_of(lookups.scan_group_info(spark, str(tmp_path / f"parts.{kind}"))) == expected
    with pytest.raises(ValueError, match="must be"):
        lookups.scan_group_info(spark, str(tmp_path / "g.txt"))
    with pytest.raises(SchemaError):
        lookups.scan_keywords(spark, str(tmp_path / "g.csv"))


def test_full_run_from_files(spark, tmp_path):
    put(tmp_path, "in/1/c1.csv", f"{HEADER}\n,01/02/2024,10:00:00,1,,I love Foo milk,,\n")
    put(tmp_path, "in/2/c1.csv", f"{HEADER}\n,01/02/2024,10:00:00,1,,I love Foo milk,,\n,02/02/2024,10:00:00,1,,nothing,,\n")
    put(tmp_path, "in/2/c2.csv", f"{HEADER}\n,01/02/2024,10:00:00,1,,foo,,\n")
    put(tmp_path, "g.csv", "gus_id,group_nature\nc1,old\nc1,mums\n")
    put(tmp_path, "k.csv", "brand,product,keyword,required_product\nfoo,generic,FOO,\n")
    final = flows.run_files(
        spark, str(tmp_path / "in"), str(tmp_path / "g.csv"), str(tmp_path / "k.csv"),
        positive=["love"], negative=["hate"],
    )
    found = rows_of(final.select("sheet", "Source", "messageBody", "Reason", "foo_generic"))
    assert found == [
        ("mums", "c1", "I love Foo milk", "foo_generic: only positive words\n", "P"),
        ("mums", "c1", "nothing", "", ""),
    ]
    sinks.write_final(final, str(tmp_path / "final"))
    sinks.write_sheets(final, str(tmp_path / "sheets"), "csv")
    assert spark.read.parquet(str(tmp_path / "final")).count() == 2
    assert os.path.isdir(tmp_path / "sheets" / "sheet=mums")


def test_canonical_columns(spark):
    df = spark.createDataFrame([(7, None, "junk")], "userPhone int, messageBody string, other string")
    from pyspark.sql import functions as F

    row = chat_rows(df, source=F.lit("s")).first().asDict()
    assert list(row) == ["Source", "Group", "Date1", "Date2", "Time", "userPhone", "quotedMessage", "messageBody", "mediaType", "mediaCaption", "Reason"]
    assert (row["userPhone"], row["messageBody"], row["Date1"]) == ("7", "", None)


def test_twenty_thousand_columns(spark, tmp_path):
    """Every header gets its column, whatever the texts contain, and the plan stays small."""
    n = 20_000
    headers = spark.range(n).select(F.concat(F.lit('h,"'), "id").alias("headers"), (n - F.col("id")).alias("ord"))
    rows = [
        (1, 's"1', "two\nlines, and a comma", {'h,"0': "P", f'h,"{n - 1}': "N"}),
        (2, None, "", {}),
        (3, "é", "x", {'h,"7': "1"}),
    ]
    table = spark.createDataFrame(rows, "id int, `a.b` string, text string, cells map<string,string>")
    sinks.write_wide(table.repartition(2, "id"), headers, str(tmp_path / "wide"))
    read = {}
    for path in (tmp_path / "wide").glob("part-*"):
        with open(path, encoding="utf-8", newline="") as f:
            top, *body = list(csv.reader(f))
        assert top == ["id", "a.b", "text", *[f'h,"{i}' for i in reversed(range(n))]]
        for row in body:
            cells = {h: v for h, v in zip(top[3:], row[3:], strict=True) if v}
            read[int(row[0])] = (*row[1:3], cells)
    assert read == {i: (a or "", t, c) for i, a, t, c in rows}
    sinks.write_wide(table.limit(0), headers, str(tmp_path / "none"))
    sinks.write_wide(table, headers.limit(0), str(tmp_path / "plain"))
    lines = spark.read.text(str(tmp_path / "plain")).where("value like 'id%'").distinct().collect()
    assert [r.value for r in lines] == ["id,a.b,text"]
    one = sinks.read_cells(table, ['h,"7', "other"], blank="-").where("id = 3").first()
    assert tuple(one)[3:] == ("1", "-")


def test_places_of_keys():
    """Places come from one look-up of all keys, sorted; the old look-up went through all hits for every column."""
    names = ["b", "a", None, "é", "a"]
    lists = [["é", "x", "b"], None, [], ["a"], ["x"]]
    codes = sinks.key_places(names)(pa.array(lists, pa.list_(pa.string()))).to_pylist()
    assert [[divmod(c, 1 << 32) for c in row] for row in codes] == [[(0, 2), (3, 0)], [], [], [(1, 0), (4, 0)], []]
    assert sinks.key_places([])(pa.array([["a"], []], pa.list_(pa.string()))).to_pylist() == [[], []]
    assert sinks.key_places(names)(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_many_fields_take_little_disk(spark, tmp_path):
    """300 lines of 4,000 columns are 2.4 MB of text; compressed they take a small part of it and read the same."""
    names = spark.range(4000).select(F.concat(F.lit("h"), "id").alias("headers"), F.col("id").alias("ord"))
    hit = F.filter(F.sequence(F.lit(0), F.lit(3999)), lambda h: (h * h + F.col("id")) % 11 == 0)
    cells = F.map_from_entries(F.transform(hit, lambda h: F.struct(F.concat(F.lit("h"), h), F.lit("1"))))
    table = spark.range(300).withColumn("cells", cells).repartition(2)
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sinks.write_wide(table, names, str(tmp_path / "gzip"), blank="0", compression="gzip")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == batch
    files = list((tmp_path / "gzip").glob("part-*.gz"))
    assert sum(os.path.getsize(f) for f in files) < 300 * 4000 * 2 / 10
    read = {}
    for path in files:
        with gzip.open(path, "rt") as f:
            top, *body = [line.rstrip("\n").split(",") for line in f]
        assert top == ["id", *[f"h{i}" for i in range(4000)]]
        read |= {int(row[0]): row[1:] for row in body}
    assert read == {i: ["1" if (h * h + i) % 11 == 0 else "0" for h in range(4000)] for i in range(300)}
    lines = spark.read.text(str(tmp_path / "gzip")).where("value NOT LIKE 'id,%'")
    found = lines.select(F.split("value", ",")[0].cast("int").alias("id"), csv_files.fields_equal("value", "1").alias("f"))
    places = {r["id"]: (r["f"]["n_fields"], r["f"]["places"]) for r in found.collect()}
    assert places == {i: (4001, [j for j, x in enumerate([str(i), *read[i]]) if x == "1"]) for i in read}


def test_texts_of_cells(monkeypatch):
    """Whatever the width of the values, a few lines at a time give what one look-up a field gives."""
    monkeypatch.setattr(sinks, "TEXT_BYTES", 50)
    monkeypatch.setattr(sinks, "PLACED_KEYS", 3)
    names = ["b", "a", None, "é", "a", "c"]
    rows = [[("a", "1"), ("x", "1")], None, [], [("é", "1"), ("b", "1")], [("c", 'q",'), ("a", None), ("b", "long")], [("c", "é\n")]]
    maps = pa.array(rows, pa.map_(pa.string(), pa.string()))
    quoted = {'q",': '"q"","', "é\n": '"é\n"', None: ""}
    for blank in ("0", "", "two"):
        of = [dict(r or []) for r in rows]
        expected = ["".join("," + quoted.get(m[n], m[n]) if n in m else "," + blank for n in names) for m in of]
        for some in (slice(0, 4), slice(0, 6), slice(3, 6), slice(0, 0)):
            texts = [t for b in sinks.cell_texts(names, blank)(iter([maps[some]])) for t in b.to_pylist()]
            assert texts == expected[some]


def test_fields_equal(spark):
    lines = ["", "1", "1,1", ",1,", "11,1", "a,b", "é1,é,1", ",", "0,1,01,1"]
    # more than one batch, and lines that follow an empty one
    table = spark.createDataFrame([(i, line) for i, line in enumerate(lines * 3)], "id int, line string").coalesce(1)
    for value in ("1", "é", "11"):
        found = table.select("id", csv_files.fields_equal("line", value).alias("f")).collect()
        expected = {i: (x.count(",") + 1, [j for j, y in enumerate(x.split(",")) if y == value]) for i, x in enumerate(lines * 3)}
        assert {r["id"]: (r["f"]["n_fields"], r["f"]["places"]) for r in found} == expected
    with pytest.raises(ValueError):
        csv_files.fields_equal("line", "a,b")
