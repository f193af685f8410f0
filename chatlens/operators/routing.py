"""Routing chats to categories by the group-info table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.operators.joins import lookup_join


def natures_by_file(group_info: DataFrame) -> DataFrame:
    """``file_name, nature``: the last row of a file name counts."""
    return (
        group_info.select(
            "idx", F.concat("gus_id", F.lit(".csv")).alias("file_name"), "group_nature"
        )
        .where("file_name IS NOT NULL")
        .groupBy("file_name")
        .agg(F.max_by("group_nature", "idx").alias("nature"))
    )


def routable(natures: DataFrame) -> DataFrame:
    """Natures longer than one character; null does not route."""
    return natures.where(F.char_length("nature") > 1)


def route_chats(chats: DataFrame, group_info: DataFrame) -> DataFrame:
    """Add ``nature`` and keep the chats that have one.

    Chats are matched by file name; without a ``file_name`` column it is ``Source`` + ``.csv``.
    """
    natures = routable(natures_by_file(group_info))
    if "file_name" in chats.columns:
        return lookup_join(chats, natures, ["file_name"])
    named = chats.withColumn("file_name", F.concat("Source", F.lit(".csv")))
    return lookup_join(named, natures, ["file_name"]).drop("file_name")


def distinct_natures(group_info: DataFrame) -> DataFrame:
    """The categories that get a folder."""
    return (
        group_info.select(F.col("group_nature").alias("nature"))
        .where("nature IS NOT NULL")
        .distinct()
    )
