"""Connected components of a table of links, as alternating large-star and small-star steps.

Every step is a minimum per node and a join, never a list of neighbours, so that a node with a
large part of all links is spread over tasks. Each result is written to the shared folder, which
cuts the lineage and lets Spark split a very common node in the next join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import storage


def _lowest(links: DataFrame) -> DataFrame:
    return storage.keep(links.groupBy("u").agg(F.min("v").alias("low")), "lowest")


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest of them all."""
    both = links.select("u", "v").unionByName(
        links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    low = _lowest(both)
    return (
        both.where(F.col("v") > F.col("u"))
        .join(low, "u")
        .select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of these."""
    joined = links.join(_lowest(links), "u")
    moved = joined.where(F.col("v") != F.col("low")).select(
        F.col("v").alias("u"), F.col("low").alias("v")
    )
    return moved.unionByName(joined.select("u", F.col("low").alias("v")))


def _state(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), total).head())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node but the smallest of its component.

    ``links`` has columns ``a`` and ``b`` of one ordered type, in any order, repeated or not.
    Loops and links with a null are ignored.
    """
    links = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = storage.keep(links.distinct(), "links")
    state = _state(links)
    while True:
        links = storage.keep(_large_star(links).distinct(), "links")
        links = storage.keep(_small_star(links).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
