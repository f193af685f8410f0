"""Target-distribution importance resampling, ranked by parallel sorting by regular sampling.

Words and runs of words are hashed into buckets. A bucket weighs the logarithm of its share of the target
texts over its share of the documents, so the documents most like the target get the highest weights. Adding
Gumbel noise that depends on the document's id alone turns the highest scores into a draw without
replacement in proportion to the weights.

The draw is an exact global order, found without sending all rows to one place:

1. each task sorts its rows into a run, which is stored with the place of each row;
2. every ``step``-th row of each run is a sample; the sorted samples give regular splitters;
3. the rows of each segment between two splitters are counted where they are; prefix sums of these counts
   are the number of rows before each segment;
4. only segments that begin within the draw are exchanged, one partition each, merged there, and numbered
   from their prefix count on.

The order ends in (run, place), which no two rows share, so that equal scores or one id repeated in a third
of the rows are split over segments like all others.

Size bounds: ``buckets`` counts and weights reach the driver and the tasks; ``segments - 1`` splitters and
``segments`` counts; at most ``MAX_SAMPLES`` samples plus one a run. With S segments, R runs and
step <= N / (S * R) a segment has at most 2 N / S rows.

Cases: a null or empty text has no features, weight 0 and is never drawn (unless ``min_words`` is 0); a null ``doc_id`` gets
the noise of an empty id and comes after all others of its score; repeated rows are ranked row by row;
empty documents give no rows, an empty target weighs against frequent buckets; other columns are left out. ``doc_id`` must be an
integer. Texts of any length are cut into parts while they are read.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import PART_BYTES, shuffle_partitions, word_parts

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

MAX_SAMPLES = 1_000_000
#: A-Z become lower case; all other ASCII but a-z and 0-9 separates words.
_KEPT = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256)
)


def feature_buckets(
    text: str | None, max_words: int, buckets: int, part_bytes: int = PART_BYTES
) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``max_words`` words, in arrays of bounded length; first those of one word."""
    data = (text or "").encode().translate(_WORDS)
    for size in range(1, max_words + 1):
        for words in word_parts(data, size - 1, part_bytes):
            if size > 1:
                words = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
            yield np.fromiter(map(crc32, words), np.int64, len(words)) % buckets


def bucket_counts(texts: DataFrame, max_words: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in feature_buckets(text.as_py(), max_words, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    per_task = texts.select("text").mapInArrow(counted, "bucket long, n long")
    result = np.zeros(buckets, np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        result[row["bucket"]] = row["n"]
    return result


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's share over the documents', one added to each bucket."""
    n = len(documents)
    ours, theirs = float(documents.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * ours / ((s + 1) * theirs))) for s, t in zip(documents.tolist(), target.tolist())],
        np.int64,
    )


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, from the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.substring(F.sha2(key, 256), 1, 8)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(unit))).cast("long")


def weights(docs: DataFrame, gains: np.ndarray, max_words: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"doc_id must be an integer, not {kind.simpleString()}")
    buckets = len(gains)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for found in feature_buckets(text, max_words, buckets):
                    rows[1, i] += len(found)
                    rows[2, i] += gains[found].sum()
                rows[0, i] = rows[1, i] if max_words == 1 else sum(map(len, feature_buckets(text, 1, buckets)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *map(pa.array, rows)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        weighed, "doc_id long, n_words long, n_features long, weight long"
    )


def sorted_runs(rows: DataFrame) -> DataFrame:
    """``rows`` sorted inside each task and stored, with ``run`` and ``place``; ``eligible`` ones come first."""
    local = rows.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"))
    numbered = local.withColumns(
        {"run": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    return storage.keep(numbered, "sorted-runs")


def order_keys(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """Keys of the order, the most important one last, as ``np.lexsort`` wants them."""
    ids = batch.column("doc_id")
    of = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return [of("place"), of("run"), filled, missing, -of("score")]


def splitters(runs: DataFrame, n_rows: int, n_runs: int, segments: int) -> list[np.ndarray]:
    """``segments - 1`` regular splitters of the regular samples of all runs, as order keys."""
    per_run = min(segments * n_runs, MAX_SAMPLES)
    step = max(1, n_rows // max(per_run, 1))
    samples = runs.where(F.col("place") % step == 0).select("doc_id", "score", "run", "place")
    keys = order_keys(samples.toArrow().combine_chunks().to_batches()[0])
    order = np.lexsort(keys)
    at = [i * len(order) // segments for i in range(1, segments)]
    return [k[order][at] for k in keys]


def with_segment(runs: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Adds ``segment``: the number of splitters at or before a row."""
    n = len(cuts[0])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.concatenate(pair) for pair in zip(cuts, order_keys(batch))]
            order = np.lexsort(keys)  # stable: a splitter comes before the row it was taken from
            segment = np.empty(len(order), np.int32)
            segment[order] = np.cumsum(order < n)
            yield batch.append_column("segment", pa.array(segment[n:]))

    schema = T.StructType([*runs.schema.fields, T.StructField("segment", T.IntegerType())])
    return runs.mapInArrow(dealt, schema)


def top_ranks(runs: DataFrame, n_rows: int, drawn: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the first segments with their exact ``rank``, and the other rows without one.

    The ranked rows are at least the first ``drawn`` of the order.
    """
    n_runs = runs.agg(F.countDistinct("run")).first()[0]
    dealt = with_segment(runs, splitters(runs, n_rows, n_runs, segments))
    counts = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate(([0], np.cumsum([counts.get(i, 0) for i in range(segments)])))
    needed = int(np.searchsorted(before[:-1], drawn))  # those that begin before the last rank
    names = runs.columns
    schema = T.StructType([*runs.schema.fields, T.StructField("rank", T.LongType())])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            segment = batch.column("segment").to_numpy(zero_copy_only=False)
            rank = np.empty(len(segment), np.int64)
            for s in np.unique(segment).tolist():
                own = segment == s
                first = seen.get(s, int(before[s]))
                rank[own] = np.arange(first + 1, first + 1 + own.sum())
                seen[s] = first + int(own.sum())
            yield batch.select(names).append_column("rank", pa.array(rank))

    merged = (
        dealt.where(F.col("segment") < needed)
        .repartitionById(max(needed, 1), F.col("segment"))
        .sortWithinPartitions("segment", F.desc("score"), F.asc_nulls_last("doc_id"), "run", "place")
        .mapInArrow(ranked, schema)
    )
    return merged, dealt.where(F.col("segment") >= needed).drop("segment")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    max_words: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    min_words: int = 20,
    segments: int | None = None,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; undrawn rows have no rank.

    ``percent`` of the documents with at least ``min_words`` words are drawn, by the highest scores.
    """
    segments = segments or shuffle_partitions(docs)
    gains = bucket_gains(*(bucket_counts(t, max_words, buckets) for t in (docs, target)))
    scored = weights(docs, gains, max_words)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    runs = sorted_runs(scored.withColumn("eligible", F.col("n_words") >= min_words))
    eligible = runs.where("eligible")
    n_rows = eligible.count()
    drawn = n_rows * percent // 100
    none = F.lit(None).cast("long").alias("rank")
    found = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return runs.select(*found, none)
    first, rest = top_ranks(eligible, n_rows, drawn, segments)
    others = rest.unionByName(runs.where("NOT eligible"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return first.select(*found, rank).unionByName(others.select(*found, none))
