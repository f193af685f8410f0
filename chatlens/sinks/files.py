"""Outputs. Large chats become several consecutive files instead of one task's file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators.rows import CHRONOLOGICAL, sort_chats

# Quotes are doubled; blanks at both ends of a value are kept.
CSV_WRITE = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# A quarter of the time of gzip's own level, for a fifth more bytes.
GZIP_WRITE = {"zlib.compress.level": "FOUR"}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").options(**CSV_WRITE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_table(
    df: DataFrame, path: str, file_format: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Parquet by default; ``csv`` for the exchange format."""
    if file_format == "csv":
        write_csv(df, path, partition_by)
        return
    writer = df.write.mode("overwrite").format(file_format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def _write_ordered(
    chats: DataFrame, path: str, folders: list[str], mode: str, file_format: str
) -> None:
    # folder columns without nulls: the writer then takes the order as it is
    known = chats.withColumns({c: F.coalesce(c, F.lit("")) for c in folders})
    write_table(sort_chats(known, mode, within=folders), path, file_format, folders)


def write_merged(
    chats: DataFrame, path: str, mode: str = CHRONOLOGICAL, file_format: str = "csv"
) -> None:
    """One folder per chat, in order: files of a chat follow each other by name."""
    _write_ordered(chats, path, ["Source"], mode, file_format)


def write_by_nature(
    routed: DataFrame, path: str, mode: str = CHRONOLOGICAL, file_format: str = "csv"
) -> None:
    """One folder per category and chat."""
    _write_ordered(routed, path, ["nature", "Source"], mode, file_format)


def write_template(template: DataFrame, path: str) -> None:
    write_csv(template, path)


def _in_order(final: DataFrame, mode: str, date_format: str) -> DataFrame:
    known = final.withColumn("sheet", F.coalesce("sheet", F.lit("")))
    return sort_chats(known, mode, date_format, within=["sheet", "Source"])


def write_final(
    final: DataFrame,
    path: str,
    file_format: str = "parquet",
    mode: str = CHRONOLOGICAL,
    date_format: str = "d/M/yyyy",
) -> None:
    """All categories as one table, chat by chat in order; files follow each other by name."""
    write_table(_in_order(final, mode, date_format), path, file_format)


def write_sheets(
    final: DataFrame,
    path: str,
    file_format: str = "parquet",
    mode: str = CHRONOLOGICAL,
    date_format: str = "d/M/yyyy",
) -> None:
    """One folder per category, chat by chat in order."""
    write_table(_in_order(final, mode, date_format), path, file_format, ["sheet"])


FIRST_ROWS = (1 << 33) - 1
KEY_BITS = 32
# of lines put together at a time, and keys looked at
TEXT_BYTES = 8 * 1024 * 1024
PLACED_KEYS = 250_000
MAPS_BYTES = "4m"


def _csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike("[\",\r\n]"), quoted).otherwise(F.coalesce(value, F.lit("")))


def key_places(names: list[str | None]) -> Callable[[pa.Array], pa.Array]:
    """Function of lists of keys: where these belong among ``names``, as sorted numbers (place, number of the key in its list).

    Keys that are no name are left out, a name that comes twice has both places.
    """
    values = list(dict.fromkeys(names))
    number = {v: i for i, v in enumerate(values)}
    of = np.array([number[n] for n in names], np.int64)
    known = pa.array(values, pa.string())
    # one more, for keys that are looked up in no names at all
    times = np.bincount(of, minlength=len(values) + 1)
    first, by_value = np.cumsum(times) - times, np.argsort(of, kind="stable")

    some = PLACED_KEYS

    def codes_of(found: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many codes each list has, and all codes."""
        value = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
        n = np.where(pc.is_valid(found).to_numpy(zero_copy_only=False), times[value], 0)
        row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n)
        key = np.repeat(np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        codes = (by_value[np.repeat(first[value], n) + nth] << KEY_BITS) | key
        # hits come in the order of the headers as a rule
        if not ((codes[1:] > codes[:-1]) | (row[1:] > row[:-1])).all():
            codes = codes[np.lexsort((codes, row))]
        return np.bincount(row, minlength=len(sizes)), codes

    def places(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        keys = lists.flatten()
        found = pc.index_in(keys, value_set=known.cast(keys.type))
        ends = np.append(0, np.cumsum(sizes))
        parts, i = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        while i < len(sizes):
            k = max(i + 1, int(np.searchsorted(ends, ends[i] + some, "right")) - 1)
            parts.append(codes_of(found[ends[i] : ends[k]], sizes[i:k]))
            i = k
        many, codes = map(np.concatenate, zip(*parts))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(codes, pa.int64()))

    return places


def cell_texts(names: list[str | None], blank: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Function of batches of maps: one text a map, a field with a comma before it for each name, ``blank`` where there is no value.

    Texts are put together in flat arrays of bytes, a few lines at a time, whatever the number of names.
    """
    places, n = key_places(names), len(names)

    def field(value: str | None) -> bytes:
        value = value or ""
        quoted = '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\r\n') else value
        return ("," + quoted).encode()

    none = np.frombuffer(field(blank), np.uint8)
    width = len(none)
    lines = max(1, TEXT_BYTES // max(1, n * width))

    def texts(codes: pa.Array, keys: np.ndarray, fields: list[bytes]) -> pa.Array:
        """Of lists of codes; ``keys`` are the numbers of their fields."""
        rows, sizes = len(codes), np.diff(codes.offsets.to_numpy())
        row = np.repeat(np.arange(rows), sizes)
        cell = row * n + (codes.flatten().to_numpy() >> KEY_BITS)
        size = np.array([len(f) for f in fields], np.int64)
        own, begin = np.frombuffer(b"".join(fields), np.uint8), np.cumsum(size) - size
        long = size[keys]
        ends = np.arange(rows + 1) * (n * width)
        if (long == width).all():
            # every value is as long as the blank, which it is written over
            out = np.tile(none, rows * n)
            for i in range(1, width):
                out[cell * width + i] = own[begin[keys] + i]
        else:
            more = np.cumsum(long - width)
            into = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            at = np.repeat(cell * width + more - (long - width), long) + into
            out = np.empty(rows * n * width + (long - width).sum(), np.uint8)
            rest = np.ones(len(out), bool)
            out[at] = own[np.repeat(begin[keys], long) + into]
            rest[at] = False
            out[rest] = np.tile(none, rows * n - len(cell))
            ends = ends + np.append(0, more)[np.append(0, np.cumsum(sizes))]
        return pa.StringArray.from_buffers(rows, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))

    def batches(maps: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in maps:
            batch = pc.if_else(batch.is_valid(), batch, pa.scalar([], batch.type)) if batch.null_count else batch
            ends = batch.offsets.to_numpy()
            start, end = ends[0], ends[-1]
            codes = places(pa.ListArray.from_arrays(pa.array(ends - start), batch.keys[start:end]))
            values = batch.items[start:end].dictionary_encode("encode")
            fields, of = [field(v) for v in values.dictionary.to_pylist()], values.indices.to_numpy()
            for i in range(0, len(codes), lines):
                part = codes[i : i + lines]
                base = np.repeat(ends[i : i + len(part)] - start, np.diff(part.offsets.to_numpy()))
                yield texts(part, of[base + (part.flatten().to_numpy() & ((1 << KEY_BITS) - 1))], fields)

    return batches


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Maps of very many hits go to Python in batches of a few MB: with Spark's own size those of two tasks fill an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, MAPS_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_wide(
    table: DataFrame,
    headers: DataFrame,
    path: str,
    blank: str = "",
    mode: str = CHRONOLOGICAL,
    date_format: str = "d/M/yyyy",
    compression: str = "none",
) -> None:
    """CSV with a column for each row of ``headers(headers, ord)``, filled from the map ``cells``; else ``blank``.

    The plan is as small for 20,000 header columns as for two, and the time of a line grows with the headers it hits and with its
    bytes: the places of the hits are looked up together, and the blanks are written in one piece.
    The file has lines times headers fields; ``compression="gzip"`` stores them in a small part of these bytes.
    Tables with a chat (``sheet``, ``Source``, ``Date2``, ``Time``) are ordered as ``write_final`` does, others
    stay as they are. Each file begins with the header line; a table without rows gives no file. Nulls
    are written as blanks. The line of all headers is one text, as it is one in the file.
    """
    base = [c for c in table.columns if c != "cells"]
    in_order = F.array_sort(F.collect_list(F.struct("ord", "headers")))
    # one row, which every task gets once
    names = headers.select("ord", "headers").agg(in_order["headers"].alias("names"))
    names = names.select("names", F.array_join(F.transform("names", _csv_field), ",").alias("top"))
    every = names.first()["names"]
    cells = F.arrow_udf(cell_texts(every, blank), "string")("cells")
    filled = table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in base], cells.alias("_cells"))
    if {"sheet", "Source", "Date2", "Time"} <= set(base):
        filled = _in_order(filled, mode, date_format)
    fields = [_csv_field(F.col(f"`{c}`")) for c in base]
    line = F.concat(F.concat_ws(",", *fields), "_cells") if base else F.substr("_cells", F.lit(2))
    top = F.concat_ws(",", *[_csv_field(F.lit(c)) for c in base], *([names.select("top").scalar()] if every else []))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(FIRST_ROWS)) == 0
    numbered = filled.select(line.alias("_line"), first.alias("_first"))
    text = F.when(F.col("_first"), F.concat(top, F.lit("\n"), F.col("_line"))).otherwise(F.col("_line"))
    writer = numbered.select(text.alias("value")).write.mode("overwrite")
    with _small_batches(table.sparkSession):
        writer.option("compression", compression).options(**GZIP_WRITE).text(path)


def read_cells(table: DataFrame, headers: list[str], blank: str = "") -> DataFrame:
    """The columns of some headers out of the map ``cells`` of a stored table."""
    kept = [F.col(f"`{c}`") for c in table.columns if c != "cells"]
    return table.select(*kept, *[F.coalesce(F.element_at("cells", F.lit(h)), F.lit(blank)).alias(h) for h in headers])
