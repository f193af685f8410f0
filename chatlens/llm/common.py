"""Expressions and table helpers shared by the operators of this package."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the white space of all word and line definitions here.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def wide_hash(*values: Column) -> Column:
    """128 bits of two differently seeded hashes, for keys that must not collide."""
    return F.struct(
        F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *values).alias("h2")
    )


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_store() -> dict:
    """What a Python worker keeps from one task to the next, such as a loaded tokenizer."""
    return sys.__dict__.setdefault("_chatlens_llm_store", {})


PART_BYTES = 1 << 22
_WHITE_BYTES = re.compile(rb"[ \t-\r]")


def word_parts(data: bytes, overlap: int, part_bytes: int = PART_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in parts of bounded size that share ``overlap`` words."""
    last: list[bytes] = []
    start = 0
    while start < len(data):
        long = len(data) - start > part_bytes
        cut = _WHITE_BYTES.search(data, start + part_bytes) if long else None
        end = cut.start() if cut else len(data)
        words = last + data[start:end].split()
        yield words
        last = words[-overlap:] if overlap else []
        start = end


def shingle_hashes(
    data: bytes, size: int, seed: int = 42, part_bytes: int = PART_BYTES
) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words, space-joined, in arrays of bounded length.

    A text with fewer words is one shingle of all its words; one without words has none.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    few, none = [], True
    for words in word_parts(data, size - 1, part_bytes):
        n = len(words) - size + 1
        if n <= 0:
            few = words
            continue
        none = False
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        stops = ends[size - 1 :].tolist()
        for at in range(0, n, 1 << 15):
            to = at + (1 << 15)
            found = [digest(joined[s:e], seed) for s, e in zip(starts[at:to], stops[at:to])]
            yield np.array(found, dtype="<u8")
    if none and few:
        yield np.array([digest(b" ".join(few), seed)], dtype="<u8")


SHARES = 1_000_000


def hash_share(value: Column, wanted: int, rows: int) -> Column:
    """Is a row among the about ``wanted`` of ``rows``? Decided by two hashes, to a share of 10**-12."""
    share = SHARES * SHARES * wanted // max(rows, wanted, 1)
    first, second = F.pmod(F.xxhash64(value), F.lit(SHARES)), F.pmod(F.xxhash64(F.lit(1), value), F.lit(SHARES))
    return (first < share // SHARES) | ((first == share // SHARES) & (second < share % SHARES))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents, chosen by the hash of the id.

    The ids are broadcast: their number is bounded by ``rows``.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    chosen = known.where(hash_share(F.col("doc_id"), rows, known.count()))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
