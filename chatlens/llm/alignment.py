"""Alignment of two tokenizers over a corpus, counted by external spilling.

A text is encoded by tokenizer A with a space before it and by tokenizer B, which adds that space itself. Both
cut the same bytes, so the segments between neighbouring cuts of either are the links: each lies in one token
of A and one of B, and each overlapping pair of tokens has one. Places where both cut bound the groups.

How often a pair of ids is linked in the whole corpus is counted by its radix:

1. while texts are encoded, records (pair, document, links) are sorted with B's id first and cut by the radix of B's
   id; a full buffer becomes one run of zstd frames for each radix, written to the shared folder beside the row of each document;
2. the runs of a radix meet in groups of at most about ``group_bytes`` compressed bytes. A heap merges the runs of a group
   side by side, that is id of B by id of B, and gives one count a pair; the counts of all groups are added up;
3. the highest count of each id of B is known when its side is; the counts go back to the groups of their radix in the same
   order, where the records of each run are read again and give each document its part.

An id of B with a third of all records is one radix, whose runs are many groups: each counts apart, and only
counts, at most one a pair and group, come together.

Size bounds: a run holds at most ``RUN_LINKS`` links and one text's; a group ``group_bytes`` or one run; the counts of a radix, which a
group gets, at most the pairs of ids that occur. The number of groups of each radix (``RADICES`` numbers) passes through the driver.

Cases: texts that are null, empty, or whose tokens of A or B do not spell a space and the text (the mark of B in a text is one
such case) have no tokens: zeros and an empty digest; a null ``doc_id`` and repeated rows are counted row by row; an
empty table gives no rows; other columns are left out. A long text is encoded whole by both libraries.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import worker_store

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

RADICES = 16
RUN_LINKS = 2_000_000
CHUNK_BYTES = 1 << 20
GROUP_BYTES = 16 << 20
DOC_BITS = 20
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable ones for themselves,
    the others, in order, the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Side:
    """Token bytes of a vocabulary by id, their sizes, and the ids in decimal digits."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        width = len(str(max(len(tokens) - 1, 0)))
        digits = [str(i).encode().ljust(width + 1, b"\0") for i in range(len(tokens))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8).reshape(-1, width + 1)

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())) == data


class ByteLevel(Side):
    """A byte-level BPE file; a file of the same vocabulary as ranks encodes Latin texts faster."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        tokens = []
        for i in range(self.tokenizer.get_vocab_size()):
            token = self.tokenizer.id_to_token(i) or ""
            plain = all(c in alphabet for c in token)
            tokens.append(bytes(map(alphabet.get, token)) if plain else token.encode())
        super().__init__(tokens)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "side", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                text.encode("latin-1")
                return np.array(self.fast.encode_ordinary(text), np.int64)
            except ValueError:  # other scripts, or too much white space for its pattern
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces(Side):
    """A SentencePiece model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                tokens.append(bytes([int(piece[3:5], 16)]))
            else:
                tokens.append(piece.replace(MARK, " ").encode())
        super().__init__(tokens)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


def loaded(kind, *paths) -> Side:
    store = worker_store()
    key = ("alignment", kind.__name__, *paths)
    if key not in store:
        store[key] = kind(*paths)
    return store[key]


def aligned(a: Side, b: Side, a_ids: list[np.ndarray], b_ids: list[np.ndarray]) -> tuple:
    """``links (a id, b id, number of the text), n_links, n_groups, groups`` of encoded texts; the last three by text."""
    n = len(a_ids)
    own = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a_ids, b_ids)]
    ends = [np.cumsum(side.sizes[ids]) - 1 for side, ids in zip((a, b), own)]  # each token's last byte
    size = int(ends[0][-1]) + 1 if len(ends[0]) else 0
    cuts = np.zeros((2, size), bool)
    for cut, end in zip(cuts, ends):
        cut[end] = True
    at = np.flatnonzero(cuts[0] | cuts[1])
    link = [ids[np.cumsum(cut[at]) - cut[at]] for ids, cut in zip(own, cuts)]
    text_bytes = [int(a.sizes[x].sum()) for x in a_ids]
    text = np.repeat(np.arange(n), text_bytes)[at]
    both = cuts[0][at] & cuts[1][at]
    n_links = np.bincount(text, minlength=n)
    n_groups = np.bincount(text[both], minlength=n)
    return (*link, text), n_links, n_groups, written(a, b, own, ends, cuts, [len(x) + len(y) for x, y in zip(a_ids, b_ids)])


def written(a: Side, b: Side, own, ends, cuts, n_tokens: list[int]) -> list[bytes]:
    """The groups of each text as ``a,a|b;a|b,b``."""
    last = [cuts[1][ends[0]], cuts[0][ends[1]]]  # of its side in its group
    group = [np.cumsum(x) - x for x in last]
    until = [np.flatnonzero(x) + 1 for x in last]  # tokens of the side up to the end of each group
    before_b = np.concatenate(([0], until[1]))
    place = [np.arange(len(own[0])) + before_b[group[0]], np.arange(len(own[1])) + until[0][group[1]]]
    width = max(a.digits.shape[1], b.digits.shape[1])
    cells = np.zeros((len(own[0]) + len(own[1]), width), np.uint8)
    for side, ids, to, final, end in zip((a, b), own, place, last, b"|;"):
        cells[to, : side.digits.shape[1]] = side.digits[ids]
        cells[to, width - 1] = np.where(final, end, ord(","))
    flat = cells.ravel()
    used = flat != 0
    data = flat[used].tobytes()
    sizes = np.concatenate(([0], np.cumsum(used.reshape(cells.shape).sum(axis=1))))
    stops = sizes[np.concatenate(([0], np.cumsum(n_tokens)))]
    return [data[s : max(s, e - 1)] for s, e in zip(stops.tolist(), stops[1:].tolist())]


class Pairs:
    """Numbers of pairs of ids: by radix, then by id of B, then by id of A."""

    def __init__(self, n_a: int, n_b: int, radices: int):
        self.n_a, self.radices = n_a, radices
        self.sides = -(-n_b // radices)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b % self.radices * self.sides + b // self.radices) * self.n_a + a

    def radix(self, number):
        return number // (self.sides * self.n_a)

    def side(self, number):
        return number // self.n_a


def runs_of(records: np.ndarray, pairs: Pairs) -> Iterator[tuple[int, int, bytes, bytes]]:
    """``radix, links, head, body`` of each radix of sorted records (pair number and document in one number).

    The head has the pairs, the number of their records and of their links; the body has the records.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    first = np.flatnonzero(np.concatenate(([True], records[1:] != records[:-1])))
    times = np.diff(np.concatenate((first, [len(records)])))
    number, docs = records[first] >> DOC_BITS, records[first] & ((1 << DOC_BITS) - 1)
    radix = pairs.radix(number)
    for r in np.unique(radix).tolist():
        lo, hi = np.searchsorted(radix, r, "left"), np.searchsorted(radix, r, "right")
        starts = np.flatnonzero(np.concatenate(([True], number[lo + 1 : hi] != number[lo : hi - 1])))
        keys = number[lo:hi][starts]
        counts = np.diff(np.concatenate((starts, [hi - lo])))
        sums = np.add.reduceat(times[lo:hi], starts)
        head = np.concatenate((np.diff(keys, prepend=0), counts, sums)).astype("<i8").tobytes()
        body = np.concatenate((docs[lo:hi], times[lo:hi])).astype("<u4").tobytes()
        yield r, int(sums.sum()), pack(head), pack(body)


def read_head(head: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair numbers, numbers of records, numbers of links."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(head), "<i8").reshape(3, -1)
    return np.cumsum(data[0]), data[1], data[2]


def read_body(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their links, record by record."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<u4").reshape(2, -1)
    return data[0].astype(np.int64), data[1].astype(np.int64)


def merge_counts(heads: list[tuple], pairs: Pairs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and their links over all runs, one id of B after the other, by a heap of the runs' next sides."""
    cut, heap = [], []
    for i, (numbers, _, _) in enumerate(heads):
        side = pairs.side(numbers)
        starts = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
        cut.append((side[starts].tolist(), [*starts.tolist(), len(side)]))
        heap.append((cut[-1][0][0], i, 0))
    heapq.heapify(heap)
    while heap:
        side, numbers, sums = heap[0][0], [], []
        while heap and heap[0][0] == side:
            _, i, k = heap[0]
            sides, starts = cut[i]
            numbers.append(heads[i][0][starts[k] : starts[k + 1]])
            sums.append(heads[i][2][starts[k] : starts[k + 1]])
            if k + 1 < len(sides):
                heapq.heapreplace(heap, (sides[k + 1], i, k + 1))
            else:
                heapq.heappop(heap)
        if len(numbers) == 1:
            yield numbers[0], sums[0]
            continue
        numbers, sums = np.concatenate(numbers), np.concatenate(sums)
        order = np.argsort(numbers, kind="stable")
        numbers, sums = numbers[order], sums[order]
        starts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
        yield numbers[starts], np.add.reduceat(sums, starts)


DOC_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN_FIELDS = "radix int, run_links long, head binary, body binary"


def spilled(
    docs: DataFrame, a_path: str, a_ranks_path: str | None, b_path: str, radices: int, run_links: int
) -> DataFrame:
    """A row for each document (``head`` is null) and for each run and radix; ``row`` numbers documents, and is that of
    a run's first one."""
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + T.StructType.fromDDL(f"{DOC_FIELDS}, {RUN_FIELDS}").fields
    )
    kinds = [pa.int64()] * 4 + [pa.string()]
    run_kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(ByteLevel, a_path, a_ranks_path), loaded(Pieces, b_path)
        pairs = Pairs(len(a.tokens), len(b.tokens), radices)
        row = base = TaskContext.get().partitionId() << 33
        buffer: list[np.ndarray] = []
        held = 0
        none = np.empty(0, np.int64)

        def batch_of(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def spill() -> pa.RecordBatch:
            found = list(runs_of(np.sort(np.concatenate(buffer)), pairs)) if held else []
            empty = [pa.nulls(len(found), t) for t in (id_type, *kinds)]
            runs = [pa.array([x[k] for x in found], t) for k, t in enumerate(run_kinds)]
            return batch_of([pa.array([base] * len(found), pa.int64()), *empty, *runs])

        id_type = None
        for batch in batches:
            ids = batch.column("doc_id")
            id_type = ids.type
            at = 0
            while at < batch.num_rows:
                a_ids, b_ids, size, start = [], [], 0, at
                while at < batch.num_rows and size < CHUNK_BYTES:
                    text = batch.column("text")[at].as_py()
                    at += 1
                    x = y = none
                    if text:
                        data = b" " + text.encode()
                        x, y = a.encode(" " + text), b.encode(text)
                        if not (a.spells(x, data) and b.spells(y, data)):
                            x = y = none
                        size += len(data)
                    a_ids.append(x)
                    b_ids.append(y)
                (link_a, link_b, text_no), n_links, n_groups, groups = aligned(a, b, a_ids, b_ids)
                if held + len(link_a) > run_links or row + at - start - base >= 1 << DOC_BITS:
                    yield spill()
                    buffer, held, base = [], 0, row
                buffer.append(pairs.number(link_a, link_b) << DOC_BITS | text_no + (row - base))
                held += len(link_a)
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                counts = [[len(x) for x in a_ids], [len(y) for y in b_ids], n_groups, n_links, digests]
                yield batch_of(
                    [
                        pa.array(range(row, row + at - start), pa.int64()),
                        ids.slice(start, at - start),
                        *[pa.array(c, t) for c, t in zip(counts, kinds)],
                        *[pa.nulls(at - start, t) for t in run_kinds],
                    ]
                )
                row += at - start
        if held:
            yield spill()

    return docs.select("doc_id", "text").mapInArrow(made, schema)


def grouped(runs: DataFrame, group_bytes: int) -> DataFrame:
    """Adds ``part``: the group of a run within its radix; and ``parts``, their number."""
    size = F.octet_length("head") + F.octet_length("body")
    sizes = runs.groupBy("radix").agg(F.sum(size).alias("bytes")).collect()
    parts = {r["radix"]: -(-r["bytes"] // group_bytes) for r in sizes}
    table = F.array(*[F.lit(parts.get(r, 1)) for r in range(max(parts, default=0) + 1)])
    runs = runs.withColumn("parts", F.get(table, F.col("radix")).cast("int"))
    return runs.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))


def pair_counts(runs: DataFrame, pairs: Pairs) -> DataFrame:
    """``radix, parts, number, n, best``: links of each pair in the corpus; is that the most of its id of B?"""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []

        def counts() -> Iterator[pa.RecordBatch]:
            found, size = [], 0
            for numbers, sums in merge_counts([read_head(h) for h in heads], pairs):
                found.append((numbers, sums))
                size += len(numbers)
                if size > 1 << 17:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

        def batch_of(found: list) -> pa.RecordBatch:
            numbers, sums = (np.concatenate(x) for x in zip(*found))
            same = [pa.array(np.full(len(numbers), k, np.int32)) for k in (key[0], key[2])]
            return pa.RecordBatch.from_arrays([*same, pa.array(numbers), pa.array(sums)], names=["radix", "parts", "number", "n"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("radix", "part", "parts")))
            for new, head in zip(keys, batch.column("head")):
                if new != key:
                    if heads:
                        yield from counts()
                    key, heads = new, []
                heads.append(head.as_py())
        if heads:
            yield from counts()

    rows = runs.select("radix", "part", "parts", "head").repartition("radix", "part").sortWithinPartitions("radix", "part")
    partial = rows.mapInArrow(merged, "radix int, parts int, number long, n long")
    total = partial.groupBy("radix", "parts", "number").agg(F.sum("n").alias("n"))
    side = F.floor(F.col("number") / F.lit(pairs.n_a))
    most = F.max("n").over(Window.partitionBy(side))
    return storage.keep(total.withColumn("best", F.col("n") == most), "pair-counts")


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` of the documents of each run, to be added up by document."""
    to_groups = counts.select(
        "radix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "number", "n", "best"
    )
    rows = to_groups.unionByName(runs.select("radix", "part", "row", "head", "body"), allowMissingColumns=True)
    rows = rows.repartition("radix", "part").sortWithinPartitions("radix", "part", F.col("head").isNotNull(), "number")

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, table = None, [], None
        for batch in batches:
            radix, part = (batch.column(c).to_numpy() for c in ("radix", "part"))
            first = np.flatnonzero(np.concatenate(([True], (radix[1:] != radix[:-1]) | (part[1:] != part[:-1]))))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
                if (radix[lo], part[lo]) != key:
                    key, parts, table = (radix[lo], part[lo]), [], None
                own = batch.slice(lo, hi - lo)
                n_counts = own.column("head").null_count
                parts.append([own.column(c).slice(0, n_counts).to_numpy(zero_copy_only=False) for c in ("number", "n", "best")])
                for k in range(n_counts, hi - lo):
                    if table is None:
                        table = [np.concatenate(x) for x in zip(*parts)]
                        table[2] = table[2].astype(bool)
                    yield of_run(table, *(own.column(c)[k].as_py() for c in ("row", "head", "body")))

    def of_run(table: list[np.ndarray], row: int, head: bytes, body: bytes) -> pa.RecordBatch:
        numbers, sizes, _ = read_head(head)
        docs, times = read_body(body)
        at = np.searchsorted(table[0], numbers)
        sums, bests = np.zeros((2, int(docs.max()) + 1), np.int64)
        np.add.at(sums, docs, np.repeat(table[1][at], sizes) * times)
        np.add.at(bests, docs, np.repeat(table[2][at], sizes) * times)
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array(row + some), pa.array(bests[some]), pa.array(sums[some])], names=["row", "n_best", "count_sum"]
        )

    return rows.mapInArrow(given, "row long, n_best long, count_sum long")


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    a_ranks_path: str | None = None,
    radices: int = RADICES,
    run_links: int = RUN_LINKS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    The files must be at these paths on every worker. ``a_ranks_path`` may name A's vocabulary as a rank file.
    """
    a, b = loaded(ByteLevel, a_path, a_ranks_path), loaded(Pieces, b_path)
    pairs = Pairs(len(a.tokens), len(b.tokens), radices)
    table = storage.keep(spilled(docs, a_path, a_ranks_path, b_path, radices, run_links), "spilled")
    runs = grouped(table.where("head IS NOT NULL"), group_bytes)
    parts = contributions(runs, pair_counts(runs, pairs))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = table.where("head IS NULL").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
