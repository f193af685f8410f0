"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, classes.

A fingerprint has bit ``b`` if more than half of the shingle hashes have it. Two fingerprints that
differ in at most ``max_bits`` bits agree on all but ``max_bits`` of the ``blocks`` blocks a
fingerprint is split into. So each distinct fingerprint is sent, once for every choice of
``blocks - max_bits`` blocks, to the group of those with the same bits there, and is compared
inside the groups only. A group yields a spanning forest of its links, not all its pairs.

Size bounds: equal fingerprints are one row before they are grouped, and those of a group differ
only in the bits of ``max_bits`` blocks: with six blocks and two bits at most 2**22 rows of eight
bytes, whatever the size of the corpus. Large groups look up the few hundred values that are near
enough instead of comparing pairs.

Cases: a null text counts as an empty one; texts without words have fingerprint zero and link like
any other; rows with a null ``doc_id`` get the smallest id of their class that is not null, or
null; repeated rows are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import PART_BYTES, shingle_hashes
from chatlens.llm.components import components

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

SEED = 42
PAIRWISE = 256


def fingerprint(data: bytes, shingle: int, part_bytes: int = PART_BYTES) -> int:
    """The fingerprint as a signed 64-bit number."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data.lower(), shingle, SEED, part_bytes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` of every row."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("fingerprint", T.LongType()),
        ]
    )

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), found],
                names=["doc_id", "text_hash", "fingerprint"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(prints, schema)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """The bits of every choice of ``blocks - max_bits`` blocks."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]


def forest(values: np.ndarray, free: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that connect all values within ``max_bits`` of each other.

    ``values`` are distinct, ascending and differ only in the bits of ``free``.
    """
    n = len(values)
    labels = np.arange(n)
    if n <= PAIRWISE:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
        pairs = [np.nonzero(np.triu(near, 1))]
    else:
        bits = [1 << b for b in range(64) if free >> b & 1]
        flips = [sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)]

        def lookups():
            for flip in flips:
                other = values ^ np.uint64(flip)
                at = np.minimum(np.searchsorted(values, other), n - 1)
                hit = np.nonzero(values[at] == other)[0]
                yield hit, at[hit]

        pairs = None
    while True:
        before = labels.copy()
        for i, j in pairs if pairs is not None else lookups():
            low = np.minimum(labels[i], labels[j])
            np.minimum.at(labels, i, low)
            np.minimum.at(labels, j, low)
        labels = labels[labels]
        if (labels == before).all():
            break
    members = np.nonzero(labels != np.arange(n))[0]
    return values[labels[members]], values[members]


def links(distinct: DataFrame, max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """Links ``a, b`` whose components are those of all links within ``max_bits`` bits."""
    masks = block_masks(blocks, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    frees = [m ^ ((1 << 64) - 1) for m in masks]
    value = F.col("fingerprint")
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), value.bitwiseAND(F.lit(m)).alias("bits"))
            for i, m in enumerate(signed)
        ]
    )
    grouped = (
        distinct.select("fingerprint", F.explode(keys).alias("key"))
        .select("key.choice", "key.bits", "fingerprint")
        .repartition("choice", "bits")
        .sortWithinPartitions("choice", "bits")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, new)]
            yield from settle(held, last=False)
            held = [x[settled_until(held) :] for x in held]
        yield from settle(held, last=True)

    def settled_until(rows: list[np.ndarray]) -> int:
        """Start of the last group, which may go on in the next batch."""
        choice, bits, _ = rows
        if not len(choice):
            return 0
        other = np.nonzero((choice != choice[-1]) | (bits != bits[-1]))[0]
        return int(other[-1]) + 1 if len(other) else 0

    def settle(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        end = len(rows[0]) if last else settled_until(rows)
        choice, bits, values = (x[:end] for x in rows)
        if end < 2:
            return
        new = np.nonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]))[0] + 1
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.concatenate((starts, [end])))
        unsigned = values.view(np.uint64)
        pair = starts[sizes == 2]
        a, b = unsigned[pair], unsigned[pair + 1]
        near = np.bitwise_count(a ^ b) <= max_bits
        found = [(a[near], b[near])]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            group = np.sort(unsigned[start : start + size])
            found.append(forest(group, frees[int(choice[start])], max_bits))
        left = np.concatenate([x for x, _ in found]).view(np.int64)
        right = np.concatenate([y for _, y in found]).view(np.int64)
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return grouped.mapInArrow(compare, "a long, b long")


def classes(prints: DataFrame, max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """One row per distinct fingerprint: ``fingerprint, component_id, keep_hash``.

    ``component_id`` is the smallest doc_id of the class; ``keep_hash`` is the text hash of the row
    that stands for it. ``prints`` must be a stored table.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash"))
    distinct = storage.keep(prints.groupBy("fingerprint").agg(first.alias("first")), "distinct")
    linked = components(links(distinct, max_bits, blocks))
    of_root = F.coalesce("root", "fingerprint")
    rooted = storage.keep(
        distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
            "fingerprint", of_root.alias("root"), "first"
        ),
        "rooted",
    )
    lowest = storage.keep(rooted.groupBy("root").agg(F.min("first").alias("first")), "lowest")
    found = rooted.select("fingerprint", "root").join(lowest, "root")
    return storage.keep(
        found.select(
            "fingerprint",
            F.col("first.doc_id").alias("component_id"),
            F.col("first.text_hash").alias("keep_hash"),
        ),
        "classes",
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 6
) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component_id, keep_hash`` of every row of ``docs``."""
    prints = storage.keep(fingerprints(docs, shingle), "fingerprints")
    return prints.join(classes(prints, max_bits, blocks), "fingerprint").select(
        "doc_id", "text_hash", "fingerprint", "component_id", "keep_hash"
    )


def one_per_class(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each class; one of repeated rows."""
    found = storage.keep(near_duplicates(docs, shingle, max_bits, blocks), "near_duplicates")
    stays = found.where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
        & (F.col("text_hash") == F.col("keep_hash"))
    )
    stays = storage.keep(
        stays.groupBy(
            F.col("doc_id").alias("_stay_id"), F.col("text_hash").alias("_stay_hash")
        ).agg(F.count(F.lit(1)).alias("_stay_rows")),
        "stays",
    )
    text = F.coalesce(docs["text"], F.lit(""))

    def rows(wanted: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(wanted["_stay_id"])
        return docs.join(wanted, same & (F.xxhash64(text) == wanted["_stay_hash"]), "left_semi")

    alone, repeated = F.col("_stay_rows") == 1, F.col("_stay_rows") > 1
    once = rows(stays.where(repeated)).withColumn("_stay_hash", F.xxhash64(text))
    once = once.dropDuplicates(["doc_id", "_stay_hash"]).drop("_stay_hash")
    return rows(stays.where(alone)).unionByName(once)
