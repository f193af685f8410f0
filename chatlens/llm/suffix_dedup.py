"""Removal of long byte strings that repeat, by prefix ranks of growing length.

A byte position has, for a prefix length, a rank: equal ranks mean equal prefixes. As in prefix
doubling, Spark brings positions with equal rank pairs together round by round, each round ranks
longer prefixes of those that were not unique, and positions leave when they are unique or when
their prefix reaches the threshold. Two things differ from the textbook, which would sort all
positions of the corpus in every round:

* A rank is a name, the rolling hash of the prefix, so the pair (rank at p, rank at p + offset)
  needs no join to look up its second half. Names that decide are two independent 64-bit hashes.
* Neighbouring positions are ranked together. Every window of ``threshold`` bytes has one anchor,
  the smallest-hashed 100-byte gram in it; equal windows have equal anchors at equal distance. A
  run is a stretch of positions with the same anchor, about 120 bytes.

Rounds:

1. runs: grams of 100 bytes. A run whose gram is unique holds no repeated window and leaves; a run
   that occurs twice with all bytes around it repeats as a whole. The rest is open.
2. bins of 16 positions of the open runs: the 385 bytes that all windows of a bin share, then all
   its bytes, decide in the same way.
3. single positions of the open bins: 400 bytes, the threshold.

A class that is already known to repeat but may equal an open run of another extent keeps one
member in the next round, so that open ones find their partner. Hot grams, runs and passages are
counted by partial aggregation, and joined with tables on both sides of which Spark can split.

Cases: a null text is an empty one; rows with the same ``doc_id`` and text are separate places (so
their strings repeat), and are returned as often as they come; null ids are allowed; texts below
the threshold can't repeat; texts of any length are hashed in parts; an empty table gives no rows;
the columns ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` are replaced.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BIN = 16
PART = 1 << 19
_INDEX_BITS = 20


def odd_inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Names:
    """Rolling hash of byte strings, modulo 2**64 over random values of the bytes."""

    def __init__(self, seed: int, size: int):
        r = np.random.default_rng(seed)
        base = int(r.integers(1 << 62, 1 << 63)) * 2 + 1
        self.value = r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def powers(b: int) -> np.ndarray:
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        self.up, self.down = powers(base), powers(odd_inverse(base))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, size) -> np.ndarray:
        """Names of the strings of ``size`` bytes from ``start`` on."""
        return mix((prefix[start + size] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tagged(names: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    """Names that differ where one of the small numbers does."""
    for n in numbers:
        names = mix(names ^ mix(n.astype(np.uint64) + np.uint64(1)))
    return names


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, in linear time."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, one: Names, two: Names, threshold: int, gram: int):
    """``rank, name, lo, hi, anchor`` of the runs of one part of a text."""
    width = threshold - gram + 1
    at = np.arange(len(data) - gram + 1)
    first, second = one.prefix(data), two.prefix(data)
    names = one.of(first, at, gram)
    # The leftmost of equal names wins, as the low bits hold the position.
    low = np.uint64((1 << _INDEX_BITS) - 1)
    anchor = (window_minima((names & ~low) | at.astype(np.uint64), width) & low).astype(np.int64)
    new = np.nonzero(anchor[1:] != anchor[:-1])[0] + 1
    lo = np.concatenate(([0], new))
    hi = np.concatenate((new, [len(anchor)])) - 1
    held = anchor[lo]
    hull = tagged(two.of(second, lo, hi - lo + threshold), held - lo, hi - lo)
    return names[held], hull, lo, hi, held


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _ranked_schema(docs: DataFrame) -> T.StructType:
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    for name in ("text_hash", "rank", "name", "lo", "hi", "anchor"):
        fields.append(T.StructField(name, T.LongType()))
    return T.StructType(fields)


def _batch(source: pa.RecordBatch, owner: np.ndarray, ranked: list[np.ndarray]) -> pa.RecordBatch:
    take = pa.array(owner)
    keys = [source.column(0).take(take), source.column(1).take(take)]
    return pa.RecordBatch.from_arrays(
        keys + [signed(np.ascontiguousarray(x)) for x in ranked],
        names=["doc_id", "text_hash", "rank", "name", "lo", "hi", "anchor"],
    )


def rank_runs(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """Round 1: the runs of ``docs(doc_id, text_hash, data)``."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Names(1, PART + threshold), Names(2, PART + threshold)
        for batch in batches:
            owner, found, rows = [], [], 0
            for i, value in enumerate(batch.column(2)):
                data = np.frombuffer(value.as_buffer(), np.uint8)
                for start in range(0, len(data) - threshold + 1, PART):
                    part = data[start : start + PART + threshold - 1]
                    new = runs_of(part, one, two, threshold, gram)
                    found.append((*new[:2], *(x + start for x in new[2:])))
                    owner.append(np.full(len(new[0]), i))
                    rows += len(new[0])
                if rows > 100_000:
                    yield _batch(batch, np.concatenate(owner), [np.concatenate(x) for x in zip(*found)])
                    owner, found, rows = [], [], 0
            if rows:
                yield _batch(batch, np.concatenate(owner), [np.concatenate(x) for x in zip(*found)])

    return docs.mapInArrow(ranked, _ranked_schema(docs))


def _expand(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def rank_pieces(segments: DataFrame, threshold: int, width: int) -> DataFrame:
    """Rounds 2 and 3: bins of ``width`` positions of open stretches, or single positions.

    ``segments``: ``doc_id, text_hash, rank, lo, hi, anchor, bytes``, the bytes from ``lo`` to the
    end of the window at ``hi``.
    """

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Names(3, 2 * threshold), Names(4, 2 * threshold)
        for batch in batches:
            owner, found, rows = [], [], 0
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            for i, value in enumerate(batch.column(6)):
                rank, lo, hi, anchor = (int(c[i]) for c in columns)
                data = np.frombuffer(value.as_buffer(), np.uint8)
                far, near = anchor - lo, anchor - hi
                bins = np.arange(near // width, far // width + 1)
                a = np.maximum(lo, anchor - (bins * width + width - 1))
                b = np.minimum(hi, anchor - bins * width)
                first, second = one.prefix(data), two.prefix(data)
                if width > 1:
                    # What all windows of the bin share, whatever part of the bin is in the run.
                    shared = one.of(first, anchor - bins * width - lo, threshold - width + 1)
                    shared = tagged(shared, bins)
                else:
                    shared = np.full(len(bins), rank, np.int64).view(np.uint64)
                hull = tagged(two.of(second, a - lo, b - a + threshold), anchor - a, b - a)
                found.append((shared, hull, a, b, np.full(len(bins), anchor)))
                owner.append(np.full(len(bins), i))
                rows += len(bins)
                if rows > 100_000:
                    yield _batch(batch, np.concatenate(owner), [np.concatenate(x) for x in zip(*found)])
                    owner, found, rows = [], [], 0
            if rows:
                yield _batch(batch, np.concatenate(owner), [np.concatenate(x) for x in zip(*found)])

    return segments.mapInArrow(ranked, _ranked_schema(segments))


def settle(rows: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(stretches that repeat as a whole, stretches the next round must rank).

    Rows whose rank is unique leave. Both results are written tables.
    """
    # Any member stands for its class; all its columns come from the same row.
    place = ["doc_id", "text_hash", "lo", "hi", "anchor"]
    named = rows.groupBy("rank", "name").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in place]
    )
    named = storage.keep(named, "names")
    twice = named.where(F.col("n") > 1).select("rank", "name")
    repeated = rows.join(twice, ["rank", "name"]).select("doc_id", "text_hash", "lo", "hi")
    repeated = storage.keep(repeated, "repeated")
    if last:
        return repeated, None
    shared = named.groupBy("rank").agg(
        F.sum("n").alias("all"), F.count(F.when(F.col("n") == 1, 1)).alias("alone")
    )
    shared = shared.where((F.col("all") > 1) & (F.col("alone") > 0)).select("rank")
    still = named.join(storage.keep(shared, "ranks"), "rank").select("rank", *place)
    return repeated, storage.keep(still, "open")


def _segments(docs: DataFrame, still: DataFrame, threshold: int) -> DataFrame:
    """The bytes of open stretches, cut out of the texts that have some."""
    stretch = F.struct("rank", "lo", "hi", "anchor")
    lists = still.groupBy("doc_id", "text_hash").agg(F.collect_list(stretch).alias("stretches"))
    lists = lists.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stretches"
    )
    same = docs["doc_id"].eqNullSafe(lists["_id"]) & (docs["text_hash"] == lists["_hash"])
    # Repeated rows are in the lists once each; one of them is enough to cut from.
    found = docs.join(lists, same).select(
        "doc_id",
        "text_hash",
        F.transform(
            "stretches",
            lambda s: F.struct(
                s["rank"].alias("rank"),
                s["lo"].alias("lo"),
                s["hi"].alias("hi"),
                s["anchor"].alias("anchor"),
                F.substring(
                    F.col("data"),
                    (s["lo"] + 1).cast("int"),
                    (s["hi"] - s["lo"] + threshold).cast("int"),
                ).alias("bytes"),
            ),
        ).alias("cut"),
    )
    return found.select("doc_id", "text_hash", F.explode("cut").alias("s")).select(
        "doc_id", "text_hash", "s.*"
    )


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_stretches(docs: DataFrame, threshold: int = 400, gram: int = 100) -> DataFrame:
    """``doc_id, text_hash, lo, hi``: all positions whose ``threshold`` bytes start elsewhere too.

    ``docs``: ``doc_id, text_hash, data``. Stretches may touch.
    """
    spark = docs.sparkSession
    keys = ["doc_id", "text_hash"]
    first, still = settle(rank_runs(docs.select(*keys, "data"), threshold, gram))
    release(spark)
    segments = storage.keep(_segments(docs, still, threshold), "segments")
    release(spark)
    second, still = settle(rank_pieces(segments, threshold, BIN))
    release(spark)
    # The bins' bytes come from the segments, no longer from the texts.
    whole = segments.select(
        *keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "anchor", "bytes"
    )
    bins = still.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "rank", "lo", "hi",
        F.col("anchor").alias("_anchor"),
    )
    inside = (
        whole["doc_id"].eqNullSafe(bins["_id"])
        & (whole["text_hash"] == bins["_hash"])
        & (whole["anchor"] == bins["_anchor"])
        & (bins["lo"] >= whole["_lo"])
        & (bins["hi"] <= whole["_hi"])
    )
    cut = F.substring(
        "bytes",
        (F.col("lo") - F.col("_lo") + 1).cast("int"),
        (F.col("hi") - F.col("lo") + threshold).cast("int"),
    )
    pieces = bins.join(whole, inside).select(*keys, "rank", "lo", "hi", "anchor", cut.alias("bytes"))
    pieces = storage.keep(pieces, "pieces")
    third, _ = settle(rank_pieces(pieces, threshold, 1), last=True)
    release(spark)
    return first.unionByName(second).unionByName(third)


def remove_repeats(docs: DataFrame, threshold: int = 400, gram: int = 100) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that stay."""
    text = F.coalesce("text", F.lit(""))
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    own = [c for c in docs.columns if c not in results]
    hashed = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("data")
    )
    found = repeated_stretches(hashed, threshold, gram)
    span = F.struct(F.col("lo").alias("lo"), (F.col("hi") + threshold).alias("to"))
    lists = found.groupBy("doc_id", "text_hash").agg(F.collect_list(span).alias("_spans"))
    lists = lists.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans"
    )
    same = docs["doc_id"].eqNullSafe(lists["_id"]) & (F.xxhash64(text) == lists["_hash"])
    joined = docs.select(*[docs[f"`{c}`"] for c in own]).join(lists, same, "left")
    return _cut(joined, own)


def _cut(joined: DataFrame, own: list[str]) -> DataFrame:
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def kept(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, lows, tos in zip(texts, starts, ends):
            data = (text or "").encode()
            parts, runs, removed, reach, at = [], 0, 0, -1, 0
            for lo, to in zip(lows, tos) if lows is not None else ():
                if lo > reach:
                    runs += 1
                    parts.append(data[at:lo])
                    removed += to - lo
                else:
                    removed += max(0, to - reach)
                at = reach = max(reach, to)
            parts.append(data[at:])
            out.append((len(data), removed, runs, b"".join(parts)))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    spans = F.array_sort(F.col("_spans"))
    found = joined.withColumn("_spans", spans).withColumn(
        "_cut", kept("text", F.col("_spans")["lo"], F.col("_spans")["to"])
    )
    return found.select(*[f"`{c}`" for c in own], "_cut.*")
