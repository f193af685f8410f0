"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

``tokenize`` turns documents into pieces of at most ``capacity`` tokens. ``plan_slots`` runs
best-fit decreasing over counts of equal lengths instead of pieces: its input has one row per
length, at most ``capacity``, and its output a few runs of slots per length. ``pack`` numbers the
pieces within each length and joins them with the runs by that rank.

The rank is made of two parts, so that a length with a third of all pieces is spread over all
tasks: a row number inside (length, shard), and the number of pieces of the length in lower shards.

Size bounds: the histogram has at most ``capacity`` rows. A run takes whole groups of equal bins;
filling a bin at least halves its space, so a group is used at most log2(capacity) times and there
are at most 30 * capacity runs of six numbers. Only these reach the driver and are broadcast.

Cases: a null or empty text is one piece with the end token alone; a null ``doc_id`` and repeated
rows are packed like all others, row by row; an empty table gives no rows; other columns of the
documents are left out by ``tokenize``, those of the pieces pass through ``pack``. Texts of any length are cut at
white space while they are encoded.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import shuffle_partitions, worker_store

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

CACHED_UNITS = 300_000
CACHED_CHARS = 32
#: Unicode white space, at which the pre-tokenizer never joins a character to the one before.
SPACES = "\t-\r \x85\xa0  -     　"


class UnitIds(dict):
    """Token ids, as little-endian 32-bit numbers, of the units a text is cut into.

    A unit begins where white space follows something else; the pre-tokenizer always cuts there, so
    units can be encoded one by one. The first units met are remembered, up to a bound. ``tokenizers`` encodes
    what the faster merge table may treat differently: its added tokens and other scripts.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
        self.loose = re.compile(f"[{SPACES}] |\0")
        self.cut = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")

    def __missing__(self, unit: str) -> bytes:
        ids = None
        if self.fast is not None and "<|" not in unit:
            try:
                unit.encode("latin-1")
                ids = self.fast.encode_ordinary(unit)
            except UnicodeEncodeError:
                ids = None
        if ids is None:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(unit) <= CACHED_CHARS and len(self) < CACHED_UNITS:
            self[unit] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if self.loose.search(text):
            units = self.cut.split(text)
        else:
            units = text.replace(" ", "\0 ").split("\0")
        return b"".join([self[u] for u in units])


def unit_ids(tokenizer_path: str, ranks_path: str | None) -> UnitIds:
    key = ("unit_ids", tokenizer_path, ranks_path)
    store = worker_store()
    if key not in store:
        store[key] = UnitIds(tokenizer_path, ranks_path)
    return store[key]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    capacity: int = 1024,
    end_id: int = 2,
) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids``; ``ids`` are little-endian 32-bit numbers.

    The files must be at these paths on every worker. ``ranks_path`` may name the same vocabulary
    as a rank file, which encodes plain words faster.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_ids(tokenizer_path, ranks_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, number, start, length, parts, size = [], [], [], [], [], 0
            for i, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    row.append(i)
                    number.append(k)
                    start.append(s)
                    length.append(n)
                    parts.append(ids[4 * s : 4 * (s + n)])
                size += len(ids)
                if size > 1 << 23:
                    yield piece_batch(batch, row, number, start, length, parts)
                    row, number, start, length, parts, size = [], [], [], [], [], 0
            yield piece_batch(batch, row, number, start, length, parts)

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def piece_batch(batch, row, number, start, length, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(row, pa.int64())),
            pa.array(number, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(parts, pa.binary()),
        ],
        names=["doc_id", "piece", "start", "length", "ids"],
    )


RUN_SCHEMA = "length long, lo long, hi long, first_sequence long, per_sequence long, place long"


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing over ``{length: number of pieces}``.

    Rows of ``RUN_SCHEMA``: the pieces of ``length`` with rank ``lo`` to ``hi - 1`` go
    ``per_sequence`` each into the sequences from ``first_sequence`` on, from offset ``place`` on.
    """
    runs: list[tuple[int, ...]] = []
    spaces: list[int] = []  # in ascending order, those that have bins
    bins: dict[int, list[tuple[int, int]]] = {}  # space: (first sequence, number of sequences)
    opened = 0

    def put_back(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in bins:
                insort(spaces, space)
                bins[space] = []
            bins[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = bins[space].pop()
                if not bins[space]:
                    del bins[space]
                    spaces.pop(at)
            else:
                space, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            fit = space // length
            used = min(n, left // fit)
            taken = used * fit
            if used:
                put_back(space - fit * length, first, used)
            else:
                used, taken = 1, left
                put_back(space - taken * length, first, 1)
            runs.append((length, rank, rank + taken, first, fit, capacity - space))
            put_back(space, first + used, n - used)
            rank += taken
            left -= taken
    return runs


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``pieces`` needs ``length`` from 1 to ``capacity`` and columns that tell rows apart; it is
    written to the shared folder first, so that all its readers see the same rows.
    """
    spark = pieces.sparkSession
    own = ["_pack_shard", "_pack_row", "_pack_before"]
    shards = 2 * shuffle_partitions(pieces)
    names = [F.col(f"`{c}`") for c in pieces.columns]
    shard = F.pmod(F.xxhash64(*names), F.lit(shards)).alias(own[0])
    pieces = storage.keep(pieces.select(*names, shard), "pieces")
    per_shard = pieces.groupBy("length", own[0]).agg(F.count(F.lit(1)).alias("n"))
    per_shard = storage.keep(per_shard, "piece_counts")
    counts = {r[0]: r[1] for r in per_shard.groupBy("length").agg(F.sum("n")).collect()}
    runs = spark.createDataFrame(plan_slots(counts, capacity), RUN_SCHEMA)
    earlier = Window.partitionBy("length").orderBy(own[0])
    before = per_shard.select(
        "length",
        own[0],
        (F.sum("n").over(earlier) - F.col("n")).alias(own[2]),
    )
    inside = Window.partitionBy("length", own[0]).orderBy(*names)
    ranked = (
        pieces.withColumn(own[1], F.row_number().over(inside) - 1)
        .join(before, ["length", own[0]])
        .withColumn("_pack_rank", F.col(own[1]) + F.col(own[2]))
    )
    runs = runs.select(*[F.col(c).alias(f"_run_{c}") for c in runs.columns])
    number = F.col("_pack_rank") - F.col("_run_lo")
    per = F.col("_run_per_sequence")
    return (
        ranked.join(
            F.broadcast(runs),
            (F.col("length") == F.col("_run_length"))
            & (F.col("_pack_rank") >= F.col("_run_lo"))
            & (F.col("_pack_rank") < F.col("_run_hi")),
        )
        .select(
            *names,
            (F.col("_run_first_sequence") + F.floor(number / per)).alias("sequence_id"),
            (F.col("_run_place") + F.pmod(number, per) * F.col("length")).alias("offset"),
        )
    )
