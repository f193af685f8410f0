"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest 40-bit hashes of a text's shingles (five words, A-Z in lower
case), in ascending order; fewer than ``k`` are all there are. The sketch of a whole follows from
those of its parts (``merged``, ``merge_parts``). Sketches estimate resemblance, containment and
the number of distinct shingles.

``with_next`` pairs each document with the next one in the order of ids without a total sort in
one task: ranges of ids are cut at ids that exist, and the first document of a range is also sent
to the range before it.

Cases: a null text is an empty one; texts without words have the empty sketch, which resembles the
empty sketch only; fewer than five words are one shingle. Documents are ordered by ``doc_id`` (null
last), then by text; of repeated rows each is the next of the one before; the only row of a table
is its own next. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm import common
from chatlens.llm.common import shingle_hashes, shuffle_partitions

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

SIZE = 128
SHINGLE = 5
BITS = 40


def sketch(text: str, k: int = SIZE, shingle: int = SHINGLE) -> np.ndarray:
    """The ``k`` smallest different hashes of a text."""
    kept = np.empty(0, np.int64)
    for hashes in shingle_hashes(text.encode().lower(), shingle):
        kept = np.unique(np.concatenate((kept, (hashes >> (64 - BITS)).astype(np.int64))))[:k]
    return kept


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated shared part of all shingles of two texts; exact below ``k`` shingles."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    return float((np.isin(union, a) & np.isin(union, b)).mean())


def distinct_count(a: np.ndarray, k: int = SIZE) -> float:
    """Estimated number of different shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated part of the shingles of ``a`` that ``b`` has too."""
    union = np.union1d(a, b)[:k]
    shared = resemblance(a, b, k) * distinct_count(union, k) if len(union) else 0.0
    count = distinct_count(a, k)
    return min(1.0, shared / count) if count else 1.0


def as_text(a: np.ndarray) -> str:
    """A sketch as text; five bytes a hash."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 5).astype(np.int64)
    return raw @ (1 << np.arange(32, -1, -8, dtype=np.int64))


def sketches(docs: DataFrame, k: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a column ``sketch`` (array of long)."""

    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t or "", k, shingle) for t in texts])

    return docs.withColumn("sketch", made("text"))


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, k: int = SIZE) -> DataFrame:
    """``key, sketch`` of all parts with the same key.

    Every task keeps only the ``k`` smallest hashes of a key before they are shuffled.
    """
    hashes = parts.select(key, F.explode_outer("sketch").alias("hash")).distinct()
    order = Window.partitionBy(key).orderBy(F.col("hash").asc_nulls_last())
    smallest = hashes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return smallest.groupBy(key).agg(F.array_sort(F.collect_list("hash")).alias("sketch"))


def with_next(
    docs: DataFrame, schema: T.StructType, handle: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """``handle`` gets ``(doc_id as a scalar, text, next text)`` of the rows of a range, in order."""
    parts = 4 * shuffle_partitions(docs)
    cuts = [i / parts for i in range(1, parts)]
    known = docs.agg(
        F.percentile_approx("doc_id", cuts, 10 * parts).alias("cuts"), F.min("doc_id").alias("first")
    ).head()
    first = known["first"]
    near = np.array(sorted({b for b in known["cuts"] or [] if b > first}), np.int64)

    @F.pandas_udf("int")
    def near_range(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(near, ids.to_numpy().astype(np.int64), side="right"))

    # percentile_approx computes in float64: a bound is the first id that exists from there on.
    whole_ids = docs.select(F.col("doc_id").cast("long").alias("id")).where(F.col("id").isNotNull())
    firsts = whole_ids.groupBy(near_range("id").alias("range")).agg(F.min("id").alias("id"))
    exact = {r["id"] for r in firsts.collect()} if len(near) else set()
    bounds = np.array(sorted(b for b in exact if b > first), np.int64)

    # Nulls are filled here: pandas would round the ids of a batch with nulls to float64.
    @F.pandas_udf("array<struct<range: int, ahead: boolean>>")
    def places(ids: pd.Series, nulls: pd.Series) -> pd.Series:
        null = nulls.to_numpy(bool)
        whole = ids.to_numpy().astype(np.int64)
        at = np.where(null, len(bounds), np.searchsorted(bounds, whole, side="right"))
        out = []
        for value, missing, part in zip(whole, null, at):
            own = [{"range": int(part), "ahead": False}]
            # The first of a range is also the next of the range before.
            if part and not missing and value == bounds[part - 1]:
                own.append({"range": int(part) - 1, "ahead": True})
            if missing if first is None else (not missing and value == first):
                own.append({"range": len(bounds), "ahead": True})
            out.append(own)
        return pd.Series(out)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    filled = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("place", F.explode(places(filled, F.isnull("doc_id")))).select(
        "place.range", "place.ahead", "doc_id", "text"
    )
    order = ["range", "ahead", F.col("doc_id").asc_nulls_last(), "text"]
    rows = rows.repartition(shuffle_partitions(docs), "range").sortWithinPartitions(*order)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                part, ahead = columns[0][i].as_py(), columns[1][i].as_py()
                text = columns[3][i].as_py()
                if held is not None and held[0] == part:
                    yield held[1], held[2], text
                # Only the first row from the next range is of use.
                held = None if ahead else (part, columns[2][i], text)

    return rows.mapInArrow(lambda batches: handle(pairs(batches)), schema)


def edited_text(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edited(docs: DataFrame, k: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint, next to that of its edited text and of the next document."""
    kind = docs.schema["doc_id"].dataType
    names = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in names]
        + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
    )

    def handle(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last_text, last = None, None
        rows: list[tuple] = []
        for ident, text, following in pairs:
            own = last if text == last_text else sketch(text, k, shingle)
            edited = edited_text(text, following)
            changed = own if edited == text else sketch(edited, k, shingle)
            last_text, last = following, own if following == text else sketch(following, k, shingle)
            rows.append(
                (
                    ident,
                    len(text),
                    hashlib.sha256(edited.encode()).hexdigest(),
                    as_text(own),
                    as_text(changed),
                    resemblance(own, changed, k),
                    resemblance(own, last, k),
                )
            )
            if len(rows) == 2000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ident, *others = zip(*rows)
        kinds = [pa.int64()] + [pa.string()] * 3 + [pa.float64()] * 2
        arrays = [pa.array([x.as_py() for x in ident], ident[0].type)]
        arrays += [pa.array(x, t) for x, t in zip(others, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return with_next(docs, schema, handle)
