"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.storage import keep

BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
BLOCK = 256
GRAM = 6
LONG_GRAM = 10
MANY_LONG = 10_000
SAMPLE = 128


def fits_broadcast(
    df: DataFrame,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> bool:
    """Measure a table before broadcasting it: one job that only counts."""
    size = (
        df.select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
        .agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Join a large table with a lookup whose size is measured first.

    A small lookup is broadcast. A larger one is written to the shared folder and joined as it is:
    with a stored table on the other side, adaptive execution splits the partitions of hot keys.
    """
    if fits_broadcast(lookup, max_rows, max_bytes):
        return big.join(F.broadcast(lookup), on, how)
    return big.join(keep(lookup, "lookup"), on, how)


def contains_join(
    texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str
) -> DataFrame:
    """All distinct pairs (key, needle) where the text contains the needle, as an equi-join.

    Every needle is filed under one of its grams, the one that is rarest in a sample of the texts; needles as long as
    their gram are their own. Grams have up to ``GRAM`` characters, but if ``MANY_LONG`` needles have ``LONG_GRAM`` or more,
    these are filed under grams of that size: the more needles there are, the more of them share a short gram, and each one
    that does is compared wherever a text has the gram. Texts give (number of a block, place, gram) only, whatever the length
    of the needles and of the key, and what meets a filed gram is compared with the needle at its own place in the block. The choice
    of the gram affects the number of comparisons, never the pairs found.
    """
    wanted = needles.select(F.col(needle)).distinct()
    size = F.char_length(needle)
    filled = keep(wanted.where(size > 0).select(needle, size.alias("_size")), "needles")
    is_long = F.col("_size") >= LONG_GRAM
    bounds = filled.agg(
        F.max("_size").alias("high"),
        F.count(F.when(is_long, 1)).alias("long"),
        F.collect_set(F.when(~is_long, F.least("_size", F.lit(GRAM)))).alias("sizes"),
    ).first()
    blank = not wanted.where(size == 0).isEmpty()
    in_all = texts.where(F.col(text).isNotNull() & F.lit(blank)).select(key, F.lit("").alias(needle))
    if bounds["high"] is None:
        return in_all.distinct()
    long_gram = LONG_GRAM if bounds["long"] >= MANY_LONG else GRAM
    sizes = sorted({*bounds["sizes"], *([long_gram] if bounds["long"] else [])})
    filled = filled.withColumn("_n", F.when(is_long, F.lit(long_gram)).otherwise(F.least("_size", F.lit(GRAM))))
    # numbered before they are stored, so that the numbers stay
    blocks = _blocks(texts, key, text, bounds["high"]).withColumn("_id", F.monotonically_increasing_id())
    blocks = keep(blocks, "blocks")
    grams = _grams(blocks, sizes)
    filed = keep(_filed(filled, needle, grams), "filed")
    met = keep(
        lookup_join(grams, filed, ["_gram"]).select(
            "_id", (F.col("_place") - F.col("_at")).alias("_start"), needle, "_size", "_whole"
        ),
        "met",
    )
    # both sides are stored, so that the partition of a block that meets many needles can be split
    own = blocks.select("_id", key).join(met.where("_whole"), "_id")
    compared = blocks.join(met.where("NOT _whole"), "_id").where(
        F.substring("_shown", F.col("_start"), F.col("_size")) == F.col(needle)
    )
    found = own.select(key, needle).unionByName(compared.select(key, needle))
    return found.unionByName(in_all).distinct()


def _blocks(texts: DataFrame, key: str, text: str, high: int) -> DataFrame:
    """``key, _shown, _left, _own``: texts in blocks with ``high - 1`` characters of their neighbours.

    Blocks are of bounded size, as finding a position in a long text takes time proportional to it. ``_left``
    characters come from the block before, ``_own`` are the block's.
    """
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{max(BLOCK, high)}}}"), F.lit(0))
    # a block is at least as long as the longest needle, so that its neighbours have enough
    other = lambda i: F.coalesce(F.get("_parts", i), F.lit(""))
    pieces = F.transform(
        "_parts",
        lambda b, i: F.struct(
            F.right(other(i - 1), F.lit(high - 1)).alias("left"),
            b.alias("own"),
            F.left(other(i + 1), F.lit(high - 1)).alias("right"),
        ),
    )
    rows = texts.select(key, parts.alias("_parts")).select(key, F.explode(pieces).alias("_piece"))
    return rows.select(
        key,
        F.concat("_piece.left", "_piece.own", "_piece.right").alias("_shown"),
        F.char_length("_piece.left").alias("_left"),
        F.char_length("_piece.own").alias("_own"),
    )


def _grams(blocks: DataFrame, sizes: list[int]) -> DataFrame:
    """``_id, _place, _gram``: what begins at each place, in each of a few sizes.

    One pass over a block gives all its places: a substring would be looked for from the beginning of the block each time.
    """
    cuts = F.regexp_extract_all("_shown", F.lit(f"(?s)(?=(.{{1,{sizes[-1]}}}))."), F.lit(1))
    own = F.slice(cuts, F.col("_left") + 1, F.col("_own"))
    rows = blocks.select("_id", "_left", F.posexplode(own).alias("_at", "_cut"))
    rows = rows.select("_id", (F.col("_left") + F.col("_at") + 1).alias("_place"), "_cut")
    if len(sizes) == 1:
        return rows.where(F.char_length("_cut") >= sizes[0]).select("_id", "_place", F.col("_cut").alias("_gram"))
    rows = rows.withColumn("_n", F.explode(F.array(*map(F.lit, sizes)))).where(F.char_length("_cut") >= F.col("_n"))
    return rows.select("_id", "_place", F.left("_cut", F.col("_n")).alias("_gram"))


def _filed(filled: DataFrame, needle: str, grams: DataFrame) -> DataFrame:
    """``_gram, _at, needle, _size, _whole``: each needle under its rarest gram, which is ``_at`` characters into it."""
    of_needle = filled.select(
        needle, "_size", "_n", F.explode(F.sequence(F.lit(0), F.col("_size") - F.col("_n"))).alias("_at")
    )
    of_needle = of_needle.select(
        needle, "_size", "_at", F.substring(needle, F.col("_at") + 1, F.col("_n")).alias("_gram")
    )
    sample = grams.where(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE)) == 0)
    whole = F.char_length("_gram") == F.col("_size")
    known = lookup_join(sample, of_needle.where(~whole).select("_gram").distinct(), ["_gram"], "left_semi")
    counts = known.groupBy("_gram").agg(F.count(F.lit(1)).alias("_seen"))
    choice = F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), "_at", "_gram")
    chosen = of_needle.join(counts, "_gram", "left").groupBy(needle, "_size").agg(F.min(choice).alias("_c"))
    return chosen.select("_c._gram", "_c._at", needle, "_size").withColumn("_whole", whole)
