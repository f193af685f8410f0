"""Union, duplicate removal, row columns and order of chats."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import all_columns_hash, day_first_date, second_of_day, without_csv
from chatlens.operators.joins import fits_broadcast, lookup_join
from chatlens.schemas import CHAT_COLUMNS
from chatlens.storage import keep

CHRONOLOGICAL = "chronological"
LEXICAL = "lexical"


def union_exports(exports: list[DataFrame]) -> DataFrame:
    """Bag union by column name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)


def drop_duplicate_rows(chats: DataFrame) -> DataFrame:
    """Drop fully identical rows, nulls being equal.

    The key is the whole row, so a large chat is spread over all partitions and copies are
    already combined before the shuffle.
    """
    return chats.distinct()


# Bits of the filter that tells rows that may be repeated: 2 ** 27 are 16 MB at most.
FILTER_BITS = 27


def drop_repeated_rows(chats: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``drop_duplicate_rows`` that shuffles hashes first, and whole rows only if their hash is met twice.

    The repeated hashes set the bits of a filter of at most 2 ** ``filter_bits`` bits, which is broadcast. A row whose bit is
    not set is the only one of its kind and stays where it is; all others are compared as a whole, so that neither equal
    hashes nor shared bits change the result. The more rows are repeated, the more unique ones share a bit and
    are shuffled as well. The input is read three times: it should be stored, and must be the same each time.
    """
    # the row in one struct, so that its columns may have any names
    row = F.struct(*[F.col(f"`{c}`") for c in chats.columns])
    hashed = chats.select(row.alias("_row"), all_columns_hash(chats.columns).alias("_hash"))
    place = F.col("_hash").bitwiseAND(F.lit(2**filter_bits - 1))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    filters = repeated.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
    )
    at = F.bitmap_bit_position(place)
    byte = F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), F.pmod(at, F.lit(8)).cast("int"))
    marked = hashed.withColumn("_bucket", F.bitmap_bucket_number(place)).join(
        F.broadcast(filters), "_bucket", "left"
    )
    maybe = F.coalesce(bit, F.lit(0)) == 1
    return marked.where(~maybe).select("_row.*").union(marked.where(maybe).select("_row.*").distinct())


def fill_nulls(df: DataFrame) -> DataFrame:
    return df.fillna("")


def chat_rows(
    exports: DataFrame,
    source: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Canonical chat table: nulls to blank, phone as text, constants, fixed column order.

    A column the exports lack stays null; other columns are dropped unless named in ``keep``.
    ``source`` defaults to ``Source``, else to the file name without ``.csv``.
    """
    if source is None:
        source = (
            F.col("Source") if "Source" in exports.columns else without_csv(F.col("file_name"))
        )
    given = {
        "Source": source,
        "Group": F.lit(""),
        "Reason": F.lit(""),
    }
    columns = []
    for name in CHAT_COLUMNS:
        if name in given:
            column = given[name]
        elif name in exports.columns:
            column = F.coalesce(F.col(name).cast("string"), F.lit(""))
        else:
            column = F.lit(None).cast("string")
        columns.append(column.alias(name))
    return exports.select(*(keep or []), *columns)


def order_columns(
    chats: DataFrame, mode: str = CHRONOLOGICAL, date_format: str = "d/M/yyyy"
) -> list[Column]:
    """Sort key of a chat: by parsed day and time, or by their text; ties by all columns."""
    if mode == CHRONOLOGICAL:
        keys = [
            day_first_date("Date2", date_format).asc_nulls_last(),
            second_of_day("Time").asc_nulls_last(),
        ]
    elif mode == LEXICAL:
        keys = [F.col("Date2").asc_nulls_last(), F.col("Time").asc_nulls_last()]
    else:
        raise ValueError(f"unknown sort mode {mode!r}")
    return keys + [F.col(f"`{c}`").asc_nulls_last() for c in sorted(chats.columns)]


def _ties(chats: DataFrame, width: int = 128) -> Column:
    """Beginning of all columns in sort order, as one text that sorts like they do."""
    parts = []
    for name in sorted(chats.columns):
        if chats.schema[name].dataType.simpleString() != "string":
            break
        value = F.col(f"`{name}`")
        given = F.concat(F.lit("\u0001"), F.left(value, F.lit(width)), F.lit("\u0000"))
        parts.append(F.when(value.isNull(), F.lit("\u0002")).otherwise(given))
    return F.left(F.concat(*parts, F.lit("")), F.lit(width))


def can_sort(chats: DataFrame) -> bool:
    return {"Date2", "Time"} <= set(chats.columns)


def sort_chats(
    chats: DataFrame,
    mode: str = CHRONOLOGICAL,
    date_format: str = "d/M/yyyy",
    within: list[str] | None = None,
) -> DataFrame:
    """Order the rows by chat (or by the columns ``within``), then by day and time.

    The rows are range partitioned on chat, day, time and the beginning of the tie-breakers: a chat
    of any size is cut into consecutive partitions instead of landing in one task, and the bounds,
    which the driver samples, stay short whatever the length of the messages. Without ``Date2`` or
    ``Time`` the rows stay as they are, with a notice.
    """
    if not can_sort(chats):
        warnings.warn("Date2 or Time is missing, chats are left unsorted", stacklevel=2)
        return chats
    groups = [F.col(c).asc() for c in within or ["Source"]]
    keys = [*groups, *order_columns(chats, mode, date_format)]
    bounds = [*keys[: len(groups) + 2], _ties(chats).asc()]
    return chats.repartitionByRange(*bounds).sortWithinPartitions(*keys)


def number_rows(
    chats: DataFrame,
    mode: str = CHRONOLOGICAL,
    date_format: str = "d/M/yyyy",
    name: str = "seq",
) -> DataFrame:
    """Position of every row within its chat, without a task per chat.

    Sorted range partitions are written to the shared folder with the place of each row. A chat
    then starts at its first place in a partition, after the rows it has in earlier partitions;
    both are known from one small count per (partition, chat).
    """
    placed = keep(
        sort_chats(chats, mode, date_format)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    counts = placed.groupBy("Source", "_part").agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first")
    )
    starts = counts.select(
        "Source",
        "_part",
        (
            F.col("_first")
            - F.coalesce(
                F.expr(
                    "sum(_rows) OVER (PARTITION BY Source ORDER BY _part "
                    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                ),
                F.lit(0),
            )
        ).alias("_start"),
    )
    if fits_broadcast(starts):
        starts = F.broadcast(starts)
    return (
        placed.join(starts, ["Source", "_part"])
        .withColumn(name, F.col("_place") - F.col("_start") + 1)
        .drop("_part", "_place", "_start")
    )


def group_files(files: DataFrame, name: str = "file_name", path: str = "path") -> DataFrame:
    """Files that belong to one chat: every path with the number of files of the same name.

    One row per file, so a name with very many files is not gathered in one row.
    """
    files = files.select(F.col(name), F.col(path)).distinct()
    return lookup_join(files, files.groupBy(name).agg(F.count("*").alias("n_files")), [name])
