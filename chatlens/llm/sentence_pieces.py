"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised (a mark before it and for every space) and cut into units, which no piece
crosses. Spark counts the units of the corpus and builds the lattice of the frequent ones: their
substrings up to the longest piece are exploded, equi-joined with the piece table, grouped by unit,
and folded into token ids with the higher-order function ``aggregate``:

* unigram models: Viterbi, the best sum of scores up to each end (``viterbi_fold``);
* BPE models: the library does not take the best sum for these but joins, again and again, the
  neighbours that make the best piece (``merge_fold``, over the same lattice). Viterbi can't give the
  library's ids there, so the fold follows the model's kind.

The other units, which occur few times, would be most of the lattice and of its shuffles; a worker
encodes them by the same rule when it meets them, for BPE models all new ones of some texts at once, a join a
step in each (``Joins``). ``n_units`` only moves work between the two: the
ids do not depend on it. The table of frequent units has at most ``n_units`` rows and is sent to all workers.

Units of BPE models are cut finer, where no piece has the two characters side by side (``unit_pattern``): no join crosses
such a place, so the ids are the same, and a word is one unit whatever punctuation follows it.

Size bounds: the piece table is the vocabulary; the histogram of counts has a few hundred rows.

Cases: a null or empty text has no ids; characters without a piece become bytes, or the unknown id
if the model has no bytes; the mark itself is decoded as a space, as the library does; null ids and
repeated rows are encoded row by row; an empty table gives no rows; the columns ``ids`` and
``decoded`` are replaced, others pass through.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import let, worker_store

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

MARK = "▁"
UNIT = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
UNIT_CHARS = 64
RARE_UNITS = 100_000
BATCH_UNITS = 1 << 19
BATCH_IDS = 1 << 20
UNKNOWN_PENALTY = 10.0
SHORT_CHARS = 40
NO_PIECE = float("-inf")


@dataclass
class PieceTable:
    kind: str  # "bpe" or "unigram"
    pieces: dict[str, tuple[int, float]]
    bytes: list[int]  # ids of the byte pieces, empty if there are none
    unknown: int
    text: dict[int, bytes] = field(default_factory=dict)  # id: what it stands for

    def __post_init__(self):
        self.longest = max((len(p) for p in self.pieces), default=1)
        low = min((s for _, s in self.pieces.values()), default=0.0)
        self.score = {p: s for p, (_, s) in self.pieces.items()}
        self.unknown_score = low - UNKNOWN_PENALTY
        self.text = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.text.setdefault(self.unknown, " ⁇ ".encode())

    def of_char(self, char: str) -> list[int]:
        if char in self.pieces:
            return [self.pieces[char][0]]
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    @property
    def unit(self) -> str:
        """Pattern of the units that no piece crosses."""
        return unit_pattern(self.pieces) if self.kind == "bpe" else UNIT

    def encode_unit(self, unit: str) -> list[int]:
        return (self.merge if self.kind == "bpe" else self.viterbi)(unit)

    def merge(self, unit: str) -> list[int]:
        """Join the neighbours that make the best piece, leftmost first, until none do."""
        return self._merge_long(unit) if len(unit) > SHORT_CHARS else self._merge_short(unit)

    def _merge_short(self, unit: str) -> list[int]:
        """By looking at all neighbours for every join."""
        part = list(unit)
        scores = [self.score.get(a + b, NO_PIECE) for a, b in zip(part, part[1:])]
        while scores:
            best = max(scores)
            if best == NO_PIECE:
                break
            i = scores.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.score.get(part[i - 1] + part[i], NO_PIECE)
            if i < len(scores):
                scores[i] = self.score.get(part[i] + part[i + 1], NO_PIECE)
        return self._ids(part)

    def _ids(self, part: list) -> list[int]:
        ids: list[int] = []
        for p in part:
            if p is not None:
                ids += [self.pieces[p][0]] if p in self.pieces else self.of_char(p)
        return ids

    def _merge_long(self, unit: str) -> list[int]:
        """By a queue of joins, for units of any length."""
        part: list[str | None] = list(unit)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part):
                both = part[i] + part[j]
                if both in self.pieces:
                    heapq.heappush(heap, (-self.pieces[both][1], i, j, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or after[i] != j or part[i] + (part[j] or "") != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self._ids(part)

    def viterbi(self, unit: str) -> list[int]:
        """Path with the best sum of scores; of equal ones that with the shorter last pieces."""
        best: list[tuple] = [(0.0, 0)]
        for end in range(1, len(unit) + 1):
            found = None
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = unit[start:end]
                if piece in self.pieces:
                    score = best[start][0] + self.pieces[piece][1]
                elif end - start == 1:
                    score = best[start][0] + self.unknown_score
                else:
                    continue
                if found is None or score > found[0]:
                    found = (score, start)
            best.append(found)
        cuts, end = [], len(unit)
        while end:
            cuts.append((best[end][1], end))
            end = best[end][1]
        ids: list[int] = []
        for start, end in reversed(cuts):
            piece = unit[start:end]
            ids += [self.pieces[piece][0]] if piece in self.pieces else self.of_char(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.text.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")

    def decode_lists(self, lists: pa.Array) -> list[str]:
        """Texts of lists of ids, those of about ``BATCH_IDS`` at a time; a null is an empty list."""
        last = max(self.text)
        known = np.zeros(last + 1, bool)
        known[list(self.text)] = True
        of_id = [self.text.get(i, b"") for i in range(last + 1)]
        blob = np.frombuffer(b"".join(of_id), np.uint8)
        size = np.fromiter(map(len, of_id), np.int64, last + 1)
        first = np.cumsum(size) - size
        n = np.fromiter((len(x) if x.is_valid else 0 for x in lists), np.int64, len(lists))
        ids = lists.flatten().to_numpy()
        if len(ids) and (ids.min() < 0 or ids.max() > last or not known[ids].all()):
            raise KeyError("an id that is no piece")
        ends = np.cumsum(n)
        out, row, start = [], 0, 0
        while row < len(n):
            to = max(row + 1, int(np.searchsorted(ends, start + BATCH_IDS, "right")))
            some = ids[start : ends[to - 1]]
            sizes = size[some]
            reach = np.cumsum(sizes)
            data = blob[np.repeat(first[some] - reach + sizes, sizes) + np.arange(reach[-1] if len(some) else 0)].tobytes()
            bounds = np.append(0, reach)[ends[row:to] - start].tolist()
            for a, b in zip([0, *bounds], bounds):
                out.append(data[a:b].removeprefix(b" ").decode("utf-8", "replace"))
            row, start = to, int(ends[to - 1])
        return out


def unit_pattern(pieces) -> str:
    """``UNIT``, and units end between characters that no chain of neighbours within pieces connects.

    The two largest sets of connected characters (often the letters of two scripts) make units of their own, all other
    characters a third kind.
    Marks, which come before characters of any kind, begin a unit and connect nothing.
    """
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for piece in pieces:
        chars = piece.replace(MARK, "").replace("\n", "")
        for a, b in zip(chars, chars[1:]):
            root[top(a)] = top(b)
    sizes = Counter(top(c) for c in root)
    largest = sorted(sizes, key=lambda c: (-sizes[c], c))[:2]
    # neighbours in code order become ranges: characters between them are connected with none, and may be in any unit
    ranges: dict[str, str] = {c: "" for c in largest}
    for c, chars in groupby(sorted(root), top):
        if c in ranges:
            first, *rest = map(_in_class, chars)
            ranges[c] += f"{first}-{rest[-1]}" if rest else first
    runs = [f"[{r}]" for r in ranges.values()] + [f"[^{''.join(ranges.values())}{MARK}\n]"]
    return "|".join([*(f"{MARK}*{run}+" for run in runs), f"{MARK}+", "\n"])


def _in_class(c: str) -> str:
    return c if c.isalnum() or not c.isascii() else f"\\{c}"


class Joins:
    """Encodes many units at once by a BPE piece table, in flat arrays.

    A symbol is the number of a piece. ``made`` gives the symbol that two make, out of a table with open addresses.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, table: PieceTable):
        names = list(table.pieces)
        symbol = {p: i for i, p in enumerate(names)}
        self.ids = np.array([table.pieces[p][0] for p in names] or [0], np.int32)
        _, level = np.unique([-table.pieces[p][1] for p in names] or [0.0], return_inverse=True)
        # the last one is that of the symbol -1
        self.rank = np.append(level, self.NONE).astype(np.int32)
        self.of_code = np.full(0x110000, -1, np.int32)
        pairs = {}
        for p, made in symbol.items():
            if len(p) == 1:
                self.of_code[ord(p)] = made
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * len(names) + b] = made
        bits = max(4, (4 * len(pairs)).bit_length())
        self.count, self.shift, self.last = len(names), np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.symbol = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for slot, key in zip(self._slot(keys).tolist(), keys.tolist()):
            while self.key[slot] >= 0:
                slot = (slot + 1) & self.last
            self.key[slot], self.symbol[slot] = key, pairs[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.count + b
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.symbol[slot], np.int32(-1))
        open_ = np.nonzero((there != keys) & (there >= 0))[0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            there = self.key[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.symbol[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def encode(self, units: list[str]) -> list[bytes | None]:
        """Ids of units of one length, as int32; None for those with a character that is no piece."""
        size = len(units[0])
        codes = np.array(units, f"U{size}").view(np.uint32).reshape(len(units), size)
        symbols = self.of_code[codes]
        out: list[bytes | None] = [None] * len(units)
        rows = np.nonzero((symbols >= 0).all(axis=1))[0]
        symbols = symbols[rows]
        made = self.made(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), size - 1)
        rank = self.rank[made]
        while len(rows):
            # all units still here have had the same number of joins, so they have the same number of symbols
            width = symbols.shape[1]
            every = np.arange(len(rows))
            best = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            ended = rank[every, best] == self.NONE if width > 1 else np.ones(len(rows), bool)
            data = self.ids[symbols[ended]].tobytes()
            for k, row in enumerate(rows[ended].tolist()):
                out[row] = data[4 * width * k : 4 * width * (k + 1)]
            if ended.any():
                rows, symbols, made, rank, best = (x[~ended] for x in (rows, symbols, made, rank, best))
                every = np.arange(len(rows))
            if not len(rows):
                break
            joined = made[every, best]
            at, pair = best[:, None], np.arange(width - 2)
            symbols = np.where(np.arange(width - 1) <= at, symbols[:, :-1], symbols[:, 1:])
            symbols[every, best] = joined
            made = np.where(pair < at, made[:, :-1], made[:, 1:])
            rank = np.where(pair < at, rank[:, :-1], rank[:, 1:])
            for k, there in ((best - 1, best > 0), (best, best < width - 2)):
                r, k = every[there], k[there]
                made[r, k] = new = self.made(symbols[r, k], symbols[r, k + 1])
                rank[r, k] = self.rank[new]
        return out


def load(path: str, kind: str = "bpe") -> PieceTable:
    """The piece table of a model file; the file does not tell its kind through the library."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[piece] = (i, model.get_score(i))
    crossing = [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and p != "\n")]
    if crossing:
        raise ValueError(f"pieces cross units: {crossing[:5]}")
    return PieceTable(kind, pieces, [byte_ids[b] for b in sorted(byte_ids)], model.unk_id())


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(text == "", F.lit("")).otherwise(marked)


def frequent_units(docs: DataFrame, n_units: int, unit: str = UNIT) -> DataFrame:
    """At most ``n_units`` units, the most frequent of those with up to ``UNIT_CHARS`` characters.

    All whose counts reach a bound are taken, where the bound is found in a histogram of counts.
    """
    units = docs.select(
        F.explode(F.regexp_extract_all(normalised(F.col("text")), F.lit(unit), F.lit(0))).alias("unit")
    )
    counts = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.char_length("unit") <= UNIT_CHARS)
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    counts = storage.keep(counts.select("unit", level), "units")
    sizes = counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()
    bound, total = None, 0
    for level, n in sorted(((r["level"], r["n"]) for r in sizes), reverse=True):
        total += n
        if total > n_units:
            break
        bound = level
    wanted = F.lit(False) if bound is None else F.col("level") >= bound
    return counts.where(wanted).select("unit")


def lattice(units: DataFrame, table: PieceTable) -> DataFrame:
    """``unit, edges``; an edge is ``end, start, piece, score, ids``."""
    spark = units.sparkSession
    rows = [(p, s, [i]) for p, (i, s) in table.pieces.items()]
    pieces = F.broadcast(spark.createDataFrame(rows, "piece string, score double, ids array<int>"))
    size = F.char_length("unit")
    spans = units.select(
        "unit", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(table.longest)))).alias("size")
    ).select("unit", "size", F.explode(F.sequence(F.lit(0), size - F.col("size"))).alias("start"))
    spans = spans.select(
        "unit",
        "start",
        (F.col("start") + F.col("size")).alias("end"),
        F.substring("unit", F.col("start") + 1, F.col("size")).alias("piece"),
    )
    single = F.col("end") - F.col("start") == 1
    if table.bytes:
        digits = F.hex(F.encode("piece", "UTF-8"))
        ids = F.array(*[F.lit(i) for i in table.bytes])
        code = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        last = (F.char_length(digits) / 2).cast("int") - 1
        unknown = F.transform(F.sequence(F.lit(0), last), lambda k: F.get(ids, code(k)))
    else:
        unknown = F.array(F.lit(table.unknown))
    joined = spans.join(pieces, "piece", "left").where(F.col("score").isNotNull() | single)
    edge = F.struct(
        "end",
        "start",
        "piece",
        F.col("score").isNotNull().alias("known"),
        F.coalesce("score", F.lit(table.unknown_score)).alias("score"),
        F.when(F.col("score").isNull(), unknown).otherwise(F.col("ids")).alias("ids"),
    )
    return joined.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def viterbi_fold(unit: Column, edges: Column) -> Column:
    """Ids of the best path, one end after the other."""
    path = "array<struct<score: double, start: int, ids: array<int>>>"
    first = F.array(F.struct(F.lit(0.0), F.lit(0), F.array().cast("array<int>"))).cast(path)

    def step(best: Column, end: Column) -> Column:
        into = F.filter(edges, lambda e: e["end"] == end)
        ways = F.transform(
            into,
            lambda e: F.struct(
                (F.get(best, e["start"])["score"] + e["score"]).alias("score"),
                e["start"].alias("start"),
                F.concat(F.get(best, e["start"])["ids"], e["ids"]).alias("ids"),
            ),
        )
        return F.concat(best, F.array(F.array_max(ways)))

    folded = F.aggregate(F.sequence(F.lit(1), F.char_length(unit)), first, step)
    return F.element_at(folded, -1)["ids"]


def merge_fold(unit: Column, edges: Column) -> Column:
    """Ids after joining the best neighbours, one join a step."""
    entry = lambda e: F.struct(
        e["piece"].alias("key"),
        F.struct(e["known"].alias("known"), e["score"].alias("score"), e["ids"].alias("ids")).alias("value"),
    )

    def folded(known: Column) -> Column:
        def score(piece: Column) -> Column:
            found = known[piece]
            return F.when(found["known"], found["score"])

        def step(parts: Column, _: Column) -> Column:
            def joined(scores: Column) -> Column:
                i = F.array_position(scores, F.array_max(scores)).cast("int")
                both = F.concat(F.get(parts, i - 1), F.get(parts, i))
                rest = F.slice(parts, i + 2, F.size(parts))
                return F.when(F.array_max(scores).isNull(), parts).otherwise(
                    F.concat(F.slice(parts, F.lit(1), i - 1), F.array(both), rest)
                )

            pairs = F.transform(
                F.slice(parts, F.lit(2), F.size(parts)),
                lambda p, i: score(F.concat(F.get(parts, i), p)),
            )
            return F.when(F.size(parts) < 2, parts).otherwise(let(pairs, joined))

        chars = F.split(unit, "")
        parts = F.aggregate(F.sequence(F.lit(1), F.char_length(unit)), chars, step)
        return F.flatten(F.transform(parts, lambda p: known[p]["ids"]))

    pieces = F.array_distinct(F.transform(edges, entry))
    return let(F.map_from_entries(pieces), folded)


def unit_ids(units: DataFrame, table: PieceTable) -> DataFrame:
    """``unit, ids`` of a table of distinct units."""
    fold = merge_fold if table.kind == "bpe" else viterbi_fold
    return lattice(units, table).select("unit", fold(F.col("unit"), F.col("edges")).alias("ids"))


class RareUnits(dict):
    """Ids of the units a worker has met that are not frequent, remembered up to a bound."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table
        self.joins = Joins(table) if table.kind == "bpe" else None
        self.last: tuple[pa.Array, pa.Array] | None = None  # texts met last and their ids, until asked for again

    def encode(self, units: set[str]) -> dict[str, bytes]:
        """Ids of distinct units."""
        known = units.intersection(self)
        found = dict(zip(known, map(self.__getitem__, known)))
        for size, same in groupby(sorted(units.difference(self), key=len), len):
            same = list(same)
            together = self.joins is not None and size <= SHORT_CHARS
            many = self.joins.encode(same) if together else [None] * len(same)
            if None in many:
                one = self.table.encode_unit
                many = [np.array(one(u), np.int32).tobytes() if i is None else i for u, i in zip(same, many)]
            found.update(zip(same, many))
            if len(self) < RARE_UNITS and size <= UNIT_CHARS:
                self.update(islice(zip(same, many), RARE_UNITS - len(self)))
        return found


def encode_texts(texts: pa.Array, pattern: re.Pattern, frequent: dict[str, bytes], rare: RareUnits) -> pa.Array:
    """Lists of ids; new units are encoded together, those of about ``BATCH_UNITS`` at a time."""
    parts, ends = [], [0]
    waiting: list[list[str]] = []
    held = 0

    def encode_waiting() -> None:
        units = set().union(*waiting)
        known = units.intersection(frequent)
        ids = dict(zip(known, map(frequent.__getitem__, known)))
        ids |= rare.encode(units.difference(frequent))
        for of_text in waiting:
            parts.append(b"".join(map(ids.__getitem__, of_text)))
            ends.append(ends[-1] + len(parts[-1]) // 4)
        waiting.clear()

    for text in texts:
        text = text.as_py()
        waiting.append(pattern.findall(MARK + text.replace(" ", MARK)) if text else [])
        held += len(waiting[-1])
        if held >= BATCH_UNITS:
            encode_waiting()
            held = 0
    encode_waiting()
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode_once(texts: pa.Array, pattern: re.Pattern, frequent: dict[str, bytes], rare: RareUnits) -> pa.Array:
    """``encode_texts``, but the same texts given twice in a row are encoded once.

    Spark puts the call into every expression over the ids, so that ``decode`` asks for those of the same batch again.
    """
    if rare.last is not None and rare.last[0].equals(texts):
        ids, rare.last = rare.last[1], None
        return ids
    rare.last = None
    ids = encode_texts(texts, pattern, frequent, rare)
    rare.last = texts, ids
    return ids


def encode(docs: DataFrame, table: PieceTable, n_units: int = 300_000) -> DataFrame:
    """``docs`` with ``ids`` (array of int)."""
    spark = docs.sparkSession
    unit = table.unit
    known = storage.keep(unit_ids(frequent_units(docs, n_units, unit), table), "unit_ids")
    found = known.toPandas()
    shared = spark.sparkContext.broadcast(
        {u: np.asarray(i, np.int32).tobytes() for u, i in zip(found["unit"], found["ids"])}
    )
    pattern = re.compile(unit)
    key = ("rare_units", table.kind, zlib.crc32(repr(sorted(table.pieces.items())).encode()))

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        store = worker_store()
        if key not in store:
            store[key] = RareUnits(table)
        return encode_once(texts, pattern, shared.value, store[key])

    return docs.withColumn("ids", encoded("text"))


def decode(encoded: DataFrame, table: PieceTable) -> DataFrame:
    """``encoded(ids)`` with ``decoded``."""

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        return pa.array(table.decode_lists(ids), pa.string())

    return encoded.withColumn("decoded", decoded("ids"))
