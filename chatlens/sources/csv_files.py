"""Chat exports as CSV files.

Every column is text. Files of different column order or different columns may lie side by side.

Files are read in blocks, whatever their quotes. Whether a block begins inside a quoted field depends on
all blocks before it, but a block does one of four things to that state: leave it, turn it, open it or close it.
One pass over the lines finds which, a window over the blocks of a file adds that up, and a second pass cuts the
records of all blocks side by side; a record that runs on into further blocks is put together from their
beginnings. So one large file is read by many tasks.

A row carries its fields as one array, each file an array that says which column a field belongs to. Columns are
look-ups of these two, so that the plan grows with the columns of the result and not with the number of different
headers. Only the names of the columns reach the driver.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.text import decoded_path, without_csv
from chatlens.operators.joins import lookup_join
from chatlens.schemas import EXPORT_COLUMNS, SchemaError, text_schema
from chatlens.storage import keep

# Workers get these functions with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESERVED = ("path", "file_name")

TOO_LONG = "record longer than the header"
OPEN_QUOTE = "quote that is never closed"
NOT_UTF8 = "bytes that are not UTF-8"

# A field in quotes with doubled ones inside and perhaps more text behind, or one without.
_FIELD = re.compile(r'(?:"([^"]*+(?:""[^"]*+)*+)"([^,]*+)|([^,]*+))(?:,|(\Z))')
_TO_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_TO_COMMA = re.compile(r"[^,]*+,?")


def stays_open(line: str, opened: bool) -> bool:
    """Is a quoted field open at the end of a line, if one is at its start or not?

    A quote opens a field at its start only; behind a closing quote and inside other fields it is text.
    """
    if '"' not in line:
        return opened
    at = 0
    while True:
        if opened:
            closing = _TO_CLOSING.match(line, at)
            if not closing:
                return True
            at = closing.end()
        elif line.startswith('"', at):
            at += 1
            opened = True
            continue
        opened = False
        behind = _TO_COMMA.match(line, at).end()
        if behind == at or line[behind - 1] != ",":
            return False
        at = behind


def cut_record(record: str) -> list[str]:
    """The fields of a record."""
    if '"' not in record:
        return record.split(",")
    fields = []
    for found in _FIELD.finditer(record):
        quoted, tail, plain, end = found.groups()
        fields.append(plain if quoted is None else quoted.replace('""', '"') + tail)
        if end is not None:
            break
    return fields


def _is_blank(line: str) -> bool:
    return not line.strip(" \t\r")


def _lines(spark: SparkSession, paths: str | list[str], recursive: bool) -> DataFrame:
    """``path, start, line, valid`` of all lines; ``start`` is the place of the line's block in its file."""
    raw = spark.read.options(
        recursiveFileLookup=str(recursive).lower(), pathGlobFilter="*.csv", lineSep="\n"
    ).text(paths)
    return raw.select(
        decoded_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.make_valid_utf8("value").alias("line"),
        F.is_valid_utf8("value").alias("valid"),
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.RecordBatch]]:
    """``path, start, is it new, rows`` of the parts of batches that lie in one block."""
    last = None
    for batch in batches:
        path, start = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
        at = path.indices.to_numpy()
        new = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1])) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if lo < hi:
                key = (path[lo].as_py(), int(start[lo]))
                yield *key, key != last, batch.slice(lo, hi - lo)
                last = key


_BLOCK = "path string, start long, if_closed boolean, if_opened boolean, valid boolean, header string"


def _blocks(lines: DataFrame) -> DataFrame:
    """What each block does to the state of the quotes; is it UTF-8; the header, of the first one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        block: list = []
        begun: list[str] | None = None  # lines of a header that is not complete

        def batch_of(row: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for path, start, new, rows in _by_block(batches):
            if new:
                if block:
                    yield batch_of(block)
                block, begun = [path, start, False, True, True, None], [] if start == 0 else None
            text = rows.column("line")
            block[4] = block[4] and pc.all(rows.column("valid")).as_py()
            for i in range(len(text) if begun is not None else 0):
                line = text[i].as_py()
                if begun or not _is_blank(line):
                    opened = stays_open(line if begun else line.lstrip("\ufeff"), bool(begun))
                    begun.append(line)
                    if not opened:
                        block[5] = "\n".join(begun).lstrip("\ufeff").removesuffix("\r")
                        begun = None
                        break
            for line in text.filter(pc.match_substring(text, '"')):
                line = line.as_py()
                block[2], block[3] = stays_open(line, block[2]), stays_open(line, block[3])
        if block:
            yield batch_of(block)

    return keep(lines.mapInArrow(found, _BLOCK), "csv-blocks")


def _with_state(blocks: DataFrame) -> DataFrame:
    """Adds ``opened`` and ``ends_open``: is a quoted field open where the block begins, and where it ends?

    That is what the last block says that leaves one state whatever it found, turned once for each block
    since then that turns the state.
    """
    order = Window.partitionBy("path").orderBy("start")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = F.sum((F.col("if_closed") & ~F.col("if_opened")).cast("int")).over(until)
    fixed = F.when(F.col("if_closed") == F.col("if_opened"), F.struct("if_closed", "turns"))
    blocks = blocks.withColumn("turns", turns)
    last = F.last(fixed, ignorenulls=True).over(until)
    blocks = blocks.withColumn("last", F.coalesce(last, F.struct(F.lit(False).alias("if_closed"), F.lit(0).alias("turns"))))
    turned = (F.col("turns") - F.col("last.turns")) % 2 == 1
    blocks = blocks.withColumn("ends_open", F.col("last.if_closed") != turned)
    return blocks.withColumn("opened", F.coalesce(F.lag("ends_open").over(order), F.lit(False)))


_RECORD = "path string, start long, i long, fields array<string>, filled int, fragment string, leads boolean, open boolean"


class _Records:
    """Rows of ``_RECORD``, given in batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, path: str, start: int, i: int, record: str) -> None:
        fields = cut_record(record.removesuffix("\r"))
        while fields and not fields[-1]:
            fields.pop()
        self.rows.append((path, start, i, fields, len(fields), None, None, None))

    def fragment(self, path: str, start: int, i: int, lines: list[str], leads: bool, opened: bool) -> None:
        self.rows.append((path, start, i, None, None, "\n".join(lines), leads, opened))

    def taken(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            names = [f.split()[0] for f in _RECORD.split(", ")]
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _cut(lines: DataFrame) -> DataFrame:
    """Records that begin and end in one block, numbered there by ``i``, and fragments of the others.

    ``lines`` have ``opened``. A fragment leads if its record began in a block before; ``open`` tells whether
    the record goes on in the next block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Records()
        path = start = lead = pending = None
        i, header = 0, False

        def end_block() -> None:
            if lead is not None:
                found.fragment(path, start, -1, lead, True, True)
            if pending is not None and not header:
                found.fragment(path, start, i, pending, False, True)

        for new_path, new_start, new, rows in _by_block(batches):
            if new:
                end_block()
                path, start, i, header, pending = new_path, new_start, 0, new_start == 0, None
                lead = [] if rows.column("opened")[0].as_py() else None
            for line in rows.column("line").to_pylist():
                if lead is not None:
                    lead.append(line)
                    if not stays_open(line, True):
                        found.fragment(path, start, -1, lead, True, False)
                        lead = None
                    continue
                if pending is not None:
                    pending.append(line)
                    if stays_open(line, True):
                        continue
                    line, pending = "\n".join(pending), None
                elif _is_blank(line):
                    continue
                elif stays_open(line.lstrip("\ufeff") if header else line, False):
                    pending = [line]
                    continue
                if header:
                    header = False
                else:
                    found.add(path, start, i, line)
                    i += 1
            yield from found.taken(5000)
        end_block()
        yield from found.taken()

    return keep(lines.select("path", "start", "line", "opened").mapInArrow(cut, _RECORD), "csv-records")


def _put_together(records: DataFrame) -> DataFrame:
    """The records whose fragments lie in several blocks, as rows of the block they begin in."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, begun, lines = _Records(), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if begun is not None and row["path"] != begun[0]:
                    begun = None
                if not row["leads"]:
                    begun, lines = (row["path"], row["start"], row["i"]), [row["fragment"]]
                elif begun is not None:
                    lines.append(row["fragment"])
                    if not row["open"]:
                        found.add(*begun, "\n".join(lines))
                        begun = None
            yield from found.taken()

    fragments = records.where("fragment IS NOT NULL")
    # a handful of rows a block, in the order of the file
    ordered = fragments.repartition("path").sortWithinPartitions("path", "start", F.desc("leads"))
    return ordered.mapInArrow(joined, _RECORD)


def _free(name: str, taken: set[str]) -> str:
    """The name, or the name with the first number that no other name has, whatever the case."""
    found, count = name, 0
    while found.lower() in taken:
        count += 1
        found = f"{name}.{count}"
    taken.add(found.lower())
    return found


def column_names(header: str) -> list[str]:
    """Column names of a header; blanks and names that differ in case at most get a number."""
    taken = set(RESERVED)
    return [_free(name or f"Unnamed: {i}", taken) for i, name in enumerate(cut_record(header))]


def output_names(names: list[str]) -> list[str]:
    """The column each name goes to: names of different files that differ in case get a number."""
    taken = set(RESERVED)
    return [_free(name, taken) for name in names]


def _names(header: str) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def names(headers: pa.Array) -> pa.Array:
        return pa.array([column_names(h) for h in headers.to_pylist()], pa.list_(pa.string()))

    return names(header)


@dataclass
class _Tree:
    """CSV files below some paths: a row for each file, for each different header, and for each record."""

    spark: SparkSession
    files: DataFrame  # path, header, valid, ends_open
    headers: DataFrame  # header, names
    records: DataFrame  # path, start, i, fields, filled

    @classmethod
    def scan(cls, spark: SparkSession, paths: str | list[str], recursive: bool) -> _Tree:
        lines = _lines(spark, paths, recursive)
        blocks = keep(_with_state(_blocks(lines)), "csv-states")
        files = blocks.groupBy("path").agg(
            F.max("header").alias("header"),
            F.bool_and("valid").alias("valid"),
            F.max_by("ends_open", "start").alias("ends_open"),
        )
        # a file of blank lines has no header, one that ends inside its header has all of it there
        files = keep(files.where("header IS NOT NULL OR ends_open"), "csv-files")
        headers = files.where("header IS NOT NULL").select("header").distinct()
        headers = keep(headers.select("header", _names("header").alias("names")), "csv-headers")
        opened = blocks.where("opened").select("path", "start", F.lit(True).alias("opened"))
        if opened.isEmpty():
            lines = lines.withColumn("opened", F.lit(False))
        else:
            numbered = lines.withColumn("n", F.monotonically_increasing_id())
            lines = lookup_join(numbered, opened, ["path", "start"], "left")
            lines = lines.withColumn("opened", F.coalesce("opened", F.lit(False)))
            # a large table of blocks is joined by a shuffle, after which the lines of a block need their order
            lines = lines.sortWithinPartitions("path", "start", "n")
        cut = _cut(lines)
        names = ["path", "start", "i", "fields", "filled"]
        whole = cut.where("fields IS NOT NULL").select(*names)
        return cls(spark, files, headers, whole.unionByName(_put_together(cut).select(*names)))

    def bad_records(self) -> DataFrame:
        """``(path, record, fault)`` of records and files no reader should trust."""
        fault = F.when(~F.col("valid"), NOT_UTF8).when(F.col("ends_open"), OPEN_QUOTE)
        files = self.files.join(self.headers, "header", "left").select(
            "path", fault.alias("fault"), F.coalesce(F.size("names"), F.lit(0)).alias("width")
        )
        whole = files.where("fault IS NOT NULL").select("path", F.lit(None).cast("string").alias("record"), "fault")
        rows = lookup_join(self.records, files.where("fault IS NULL").select("path", "width"), ["path"])
        longer = rows.where(F.col("filled") > F.col("width"))
        record = F.array_join("fields", ",").alias("record")
        return whole.unionByName(longer.select("path", record, F.lit(TOO_LONG).alias("fault")))

    def missing(self, required: list[str]) -> tuple[str, list[str]] | None:
        """The first file that lacks a column, and the columns it lacks."""
        lacks = F.array_except(F.array(*map(F.lit, required)), "names").alias("lacks")
        found = self.headers.select("header", lacks).where(F.size("lacks") > 0)
        first = self.files.join(found, "header").agg(F.min(F.struct("path", "lacks")).alias("first")).first()["first"]
        return (first["path"], first["lacks"]) if first else None

    def named(self, without: DataFrame | None) -> DataFrame:
        """The records of the files that are not in ``without(path)``, with the names of their headers."""
        each = self.headers.select("header", F.posexplode("names").alias("i", "name"))
        first = each.groupBy("name").agg(F.min(F.struct("header", "i")).alias("first"))
        names = [r["name"] for r in first.orderBy("first").collect()]
        columns = output_names(names)
        numbers = self.spark.createDataFrame(list(zip(names, range(len(names)))), "name string, number int")
        targets = (
            each.join(F.broadcast(numbers), "name")
            .groupBy("header")
            .agg(F.array_sort(F.collect_list(F.struct("i", "number"))).alias("found"))
            .select("header", F.col("found.number").alias("_targets"))
        )
        files = self.files if without is None else self.files.join(without, "path", "left_anti")
        files = files.join(targets, "header").select("path", "_targets")
        field = lambda target, i: F.struct(target, F.nullif(F.get("fields", i), F.lit("")))
        rows = lookup_join(self.records, files, ["path"])
        rows = rows.withColumn("_field", F.map_from_entries(F.transform("_targets", field)))
        file_name = F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name")
        values = [F.try_element_at("_field", F.lit(k)).alias(c) for k, c in enumerate(columns)]
        return rows.select(*values, "path", file_name, F.col("start").alias("_start"), F.col("i").alias("_i"))


def _with_positions(rows: DataFrame) -> DataFrame:
    """``_pos`` instead of ``_start`` and ``_i``: the number of a record in its file, without gaps."""
    counts = rows.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_start")) - F.col("_n")
    rows = lookup_join(rows, counts.select("path", "_start", before.alias("_before")), ["path", "_start"])
    return rows.withColumn("_pos", F.col("_before") + F.col("_i")).drop("_before", "_start", "_i")


def scan_csv(
    spark: SparkSession,
    paths: str | list[str],
    recursive: bool = True,
    bad_files: str = "skip",
    required: list[str] | None = None,
    na_tokens: list[str] | None = None,
    positions: bool = False,
) -> DataFrame:
    """All CSV files below ``paths``, united by column name; parsed once, into the shared folder.

    Adds ``path`` and ``file_name``. Records end with a line, at ``\\n`` or ``\\r\\n``, outside of quotes; lines of
    blanks are left out. Short records are filled with nulls, and empty fields past the header are ignored. A file is bad if a record has more than that, if a quote is never
    closed, or if it is not UTF-8: ``skip`` leaves such files out with a warning, ``fail`` raises.
    ``na_tokens`` are texts to read as null. ``positions`` adds ``_pos``, the number of a record in its file.
    """
    if bad_files not in ("skip", "fail"):
        raise ValueError(f"unknown treatment of bad files {bad_files!r}")
    tree = _Tree.scan(spark, paths, recursive)
    missing = tree.missing(required) if required else None
    if missing:
        raise SchemaError(f"{missing[0]}: missing columns {missing[1]}")
    bad = None
    if bad_files == "fail":
        first = tree.bad_records().limit(1).collect()
        if first:
            raise ValueError(f"{first[0]['path']}: {first[0]['fault']}: {first[0]['record'] or ''}")
    else:
        bad = keep(tree.bad_records().select("path").distinct(), "csv-bad")
        count = bad.count()
        if count:
            warnings.warn(f"skipped {count} unreadable CSV files", stacklevel=2)
    if tree.headers.isEmpty():
        return spark.createDataFrame([], text_schema([*EXPORT_COLUMNS, "path", "file_name"]))
    rows = tree.named(bad)
    rows = _with_positions(rows) if positions else rows.drop("_start", "_i")
    if na_tokens:
        own = [c for c in rows.columns if c not in (*RESERVED, "_pos")]
        rows = rows.withColumns(
            {c: F.when(~F.col(f"`{c}`").isin(na_tokens), F.col(f"`{c}`")) for c in own}
        )
    return rows


def bad_records(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """``(path, record, fault)`` of the records for which a file is bad."""
    return _Tree.scan(spark, paths, recursive).bad_records()


def scan_exports(spark: SparkSession, root: str, bad_files: str = "skip", **options) -> DataFrame:
    """Raw chat exports anywhere below ``root``, with ``Source`` from the file name.

    ``required=EXPORT_COLUMNS`` refuses files that lack a column.
    """
    rows = scan_csv(spark, root, recursive=True, bad_files=bad_files, **options)
    return rows.withColumn("Source", without_csv(F.col("file_name"))).drop("path")


def scan_chat_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Chat files of one folder or pattern; a bad file ends the run."""
    rows = scan_csv(spark, path, recursive=False, bad_files="fail", **options)
    return rows.withColumn("Source", without_csv(F.col("file_name"))).drop("path")


def scan_folders(spark: SparkSession, root: str, **options) -> DataFrame:
    """``root/<sheet>/*.csv``: each direct sub-folder is a sheet. A bad file ends the run."""
    rows = scan_csv(
        spark,
        f"{root.rstrip('/')}/*/*.csv",
        recursive=False,
        bad_files="fail",
        required=EXPORT_COLUMNS,
        **options,
    )
    return (
        rows.withColumn("sheet", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
        .withColumn("Source", without_csv(F.col("file_name")))
        .drop("path")
    )


def scan_partitioned(
    spark: SparkSession, root: str, columns: list[str], partitions: list[str]
) -> DataFrame:
    """CSV written by the sinks; partition values stay text, blanks come back as blanks."""
    schema = text_schema([*columns, *partitions])
    return (
        spark.read.schema(schema)
        .options(header="true", multiLine="true", quote='"', escape='"', mode="FAILFAST")
        .csv(root)
        .select(*partitions, *columns)
    )


def scan_header(spark: SparkSession, root: str) -> list[str]:
    """Column names of CSV files written by one sink, which all have the same header; or none."""
    blocks = _blocks(_lines(spark, root, recursive=True))
    found = blocks.where("header IS NOT NULL").first()
    return column_names(found["header"]) if found else []


def list_chats(spark: SparkSession, root: str) -> DataFrame:
    """The group-info form for chats written by ``write_merged``, one row per chat."""
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup="true", pathGlobFilter="*.csv")
        .load(root)
    )
    return files.select(
        decoded_path(F.regexp_extract("path", r"/Source=([^/]*)/", 1)).alias("gus_id"),
        F.lit(None).cast("string").alias("group_nature"),
    ).distinct()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Names of all CSV files below ``root`` as a group-info form to fill in by hand.

    Only the listing is read. Empty files are not listed.
    """
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup="true", pathGlobFilter="*.csv")
        .load(root)
    )
    return files.select(
        without_csv(F.regexp_extract("path", r"([^/]*)$", 1)).alias("gus_id"),
        F.lit(None).cast("string").alias("group_nature"),
    )


def fields_equal(line: Column | str, value: str) -> Column:
    """``n_fields, places``: how many fields between commas a line has, and the places, from 0, of those equal to ``value``.

    Quotes mean nothing here. Fields are not cut: a line of very many is searched as an array of bytes, a few MB at a time.
    """
    if not value or "," in value:
        raise ValueError("only a field with text and no comma can be looked for")
    wanted, part = value.encode(), 4 * 1024 * 1024
    kind = pa.struct([("n_fields", pa.int32()), ("places", pa.list_(pa.int32()))])

    def search(data: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Of lines that follow each other: the bytes before each, and those of all."""
        comma = data == ord(",")
        # commas before each byte, and before the end
        before = np.append(np.int32(0), np.cumsum(comma, dtype=np.int32))
        n = before[ends[1:]] - before[ends[:-1]]
        begins, closes = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        begins[1:], closes[:-1] = comma, comma
        begins[ends[:-1]] = closes[ends[1:]] = True
        last = len(data) + 1 - len(wanted)
        found = begins[: max(0, last)] & closes[len(wanted) :]
        for i, byte in enumerate(wanted):
            found &= data[i : i + len(found)] == byte
        at = np.flatnonzero(found)
        row = np.searchsorted(ends, at, "right") - 1
        # not across the end of a line
        within = at + len(wanted) <= ends[row + 1]
        at, row = at[within], row[within]
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(n)))).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(before[at] - before[ends[row]]))
        return pa.StructArray.from_arrays([pa.array(n + 1), places], fields=list(kind))

    def batches(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lines:
            texts = batch.fill_null("").cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data or b"", np.uint8)
            i = 0
            while i < len(texts):
                k = max(i + 1, int(np.searchsorted(ends, ends[i] + part, "right")) - 1)
                yield search(data[ends[i] : ends[k]], ends[i : k + 1] - ends[i])
                i = k

    return F.arrow_udf(batches, "n_fields int, places array<int>")(line)
