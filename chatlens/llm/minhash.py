"""MinHash near-dedup: circulant signatures, banding, exact verification.

Two permutations of a universe of ``UNIVERSE`` places make a whole signature. The first deals shingles to
places; the second gives each place a rank. Coordinate ``k`` of a signature is the lowest rank over the
places of the shingles, all shifted circularly by ``k``. So the ranks a shingle has in all coordinates lie side
by side in the second permutation, and a signature is the minimum over such windows.

``bands`` groups of ``rows`` coordinates are the buckets of a set. With 32 bands of 4 a pair of similarity 0.8
shares no bucket in 5 of 10**8 cases. Inside the buckets nothing
is paired at large:

1. equal sets are one row (their number of documents does not matter any more);
2. every set of a bucket is compared with the first one there (a star, not all pairs), and the links that
   hold on the full sets are joined to components;
3. buckets whose sets now are of one component are done. Of the others, those with up to ``SMALL`` sets compare
   their remaining pairs of different components;
4. larger ones count, for each set outside the bucket's largest component, the shingles it shares with all others
   there through an inverted index, and give only links that join components. Buckets of more than ``LARGE`` sets are
   first split by each other band: a similar pair shares about 13 of the 32 bands, one that shares none but the first
   is met in 1 of 10**6 cases. What is still large is cut into blocks, and each pair of blocks is compared on its own.

Links are confirmed on the full sets of 64-bit shingle hashes, equality of sets by 128 bits. The cost of step 4 grows with the
square of a bucket's sets that are similar to many others but not similar enough; its memory does not.

Size bounds: a text's shingles are held by one task while it is read, the two sets of a pair while they are compared,
two blocks of about ``BLOCK_SHINGLES`` shingles in step 4; buckets, pairs and links are tables. The two permutations have 8 MB and
are made from a seed.

Cases: a null or empty text, or one without words, has no shingles, is linked with nothing and is its own component; one
with fewer words than a shingle has is one shingle; rows with a null ``doc_id`` take part and get the smallest id of their
component that is not null, or null; repeated rows are all returned; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import storage
from chatlens.llm import common
from chatlens.llm.common import shingle_hashes, wide_hash, worker_store
from chatlens.llm.components import components
from chatlens.operators.joins import lookup_join

for _module in (sys.modules[__name__], common):
    cloudpickle.register_pickle_by_value(_module)

SEED = 42
UNIVERSE = 1 << 20
WINDOWS = 1 << 10
SMALL = 16
LARGE = 1 << 12
BLOCK_SHINGLES = 1 << 21


def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each residue, and the rank of each place with the first ``width`` again at the end."""
    store = worker_store()
    key = ("minhash", width)
    if key not in store:
        random = np.random.default_rng(SEED)
        place = random.permutation(UNIVERSE).astype(np.int32)
        rank = random.permutation(UNIVERSE).astype(np.uint32)
        store[key] = place, np.concatenate((rank, rank[:width]))
    return store[key]


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """``width`` coordinates of a set of 64-bit hashes."""
    place, rank = permutations(width)
    windows = np.lib.stride_tricks.sliding_window_view(rank, width)
    places = place[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    lowest = np.full(width, UNIVERSE, np.uint32)
    for at in range(0, len(places), WINDOWS):
        np.minimum(lowest, windows[places[at : at + WINDOWS]].min(axis=0), out=lowest)
    return lowest


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, in ascending order."""
    parts = list(shingle_hashes((text or "").encode().lower(), size, SEED))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, buckets`` of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, keys, buckets = [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None)
                    buckets.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(found))
                parts = signature(found, bands * rows).reshape(bands, rows)
                buckets.append(
                    [xxhash.xxh3_64_intdigest(p.tobytes(), i) - (1 << 63) for i, p in enumerate(parts)]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("text_key", T.StructType().add("h1", "long").add("h2", "long")),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("buckets", T.ArrayType(T.LongType())),
        ]
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows_in = docs.select("doc_id", wide_hash(text).alias("text_key"), text.alias("text"))
    return rows_in.mapInArrow(made, schema)


def distinct_sets(found: DataFrame) -> DataFrame:
    """One row per set: ``rep`` (its number), ``first`` (the row that stands for it), ``n_shingles, buckets``.

    ``first`` is the row with the smallest id, nulls last.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    grouped = found.where("set_key IS NOT NULL").groupBy("set_key")
    sets = grouped.agg(
        F.min(order).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("buckets").alias("buckets")
    )
    return storage.keep(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")


def with_others(rows: DataFrame) -> DataFrame:
    """The rows of buckets with at least two sets, and the number of sets there."""
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    return storage.keep(rows.join(storage.keep(several, "sizes"), "bucket"), "buckets")


def first_buckets(sets: DataFrame) -> DataFrame:
    """``bucket, rep, n_shingles, n_sets`` of the buckets with several sets."""
    rows = sets.select("rep", "n_shingles", F.posexplode("buckets").alias("band", "value"))
    bucket = F.struct("band", "value").alias("bucket")
    return with_others(storage.keep(rows.select(bucket, "rep", "n_shingles"), "buckets"))


def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``root``, the smallest set that the links join a set with."""
    linked = components(links).withColumnRenamed("node", "rep")
    found = rows.join(linked, "rep", "left")
    return storage.keep(found.withColumn("root", F.coalesce("root", "rep")), "rooted")


def unsettled(rows: DataFrame) -> DataFrame:
    """Rows of buckets with sets of several components that are not just the pair that has been compared."""
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = storage.keep(mixed.where("low <> high").select("bucket"), "mixed")
    return storage.keep(rows.where("n_sets > 2").join(mixed, "bucket", "left_semi"), "unsettled")


def near_sizes(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of the first set of each bucket and each other one there."""
    first = rows.groupBy("bucket").agg(F.min(F.struct("rep", "n_shingles")).alias("first"))
    pairs = rows.join(storage.keep(first, "firsts"), "bucket")
    pairs = pairs.where(
        (F.col("rep") != F.col("first.rep"))
        & near_sizes(F.col("n_shingles"), F.col("first.n_shingles"), percent)
    )
    return pairs.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()


def small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in buckets of at most ``SMALL`` sets."""
    small = rows.where(F.col("n_sets") <= SMALL)
    other = small.select(
        "bucket", F.col("rep").alias("b"), F.col("root").alias("b_root"), F.col("n_shingles").alias("b_size")
    )
    pairs = small.withColumnRenamed("rep", "a").join(other, "bucket")
    pairs = pairs.where(
        (F.col("a") < F.col("b"))
        & (F.col("root") != F.col("b_root"))
        & near_sizes(F.col("n_shingles"), F.col("b_size"), percent)
    )
    return pairs.select("a", "b").distinct()


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``rep, shingles`` of the sets ``wanted(rep)``, read from their texts again."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(found, pa.binary())], names=["rep", "shingles"]
            )

    # a null id is compared like others: a list with a null is not null
    key = F.struct(F.array("first.doc_id").alias("id"), F.col("first.text_key").alias("text_key"))
    rows = storage.keep(sets.join(wanted, "rep", "left_semi").select(key.alias("row_key"), "rep"), "wanted")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.struct(F.array("doc_id").alias("id"), wide_hash(text).alias("text_key"))
    texts = lookup_join(docs.select(own.alias("row_key"), text.alias("text")), rows, ["row_key"])
    made_sets = texts.select("rep", "text").mapInArrow(made, "rep long, shingles binary")
    # rows that are repeated have one set
    return storage.keep(made_sets.groupBy("rep").agg(F.first("shingles").alias("shingles")), "shingles")


def verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have at least ``percent`` of their union in common."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                few, many = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                both = int((many[at] == few).sum())
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
            yield kept

    left = shingles.select(F.col("rep").alias("a"), F.col("shingles").alias("a_set"))
    right = shingles.select(F.col("rep").alias("b"), F.col("shingles").alias("b_set"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_set", "b_set")
    return both.mapInArrow(checked, "a long, b long")


def split_large(rows: DataFrame, sets: DataFrame, large: int) -> DataFrame:
    """Buckets of more than ``large`` sets become those of two bands each; the others stay."""
    more = rows.where(F.col("n_sets") > large).join(
        sets.select("rep", F.posexplode("buckets").alias("band", "value")), "rep"
    )
    more = more.where(F.col("band") != F.col("bucket.band"))
    both = F.array_sort(F.array("bucket", F.struct("band", "value")))
    bucket = F.struct(F.lit(-1).alias("band"), F.xxhash64(both).alias("value")).alias("bucket")
    split = more.select("rep", "n_shingles", "root", bucket).distinct()
    same = rows.where(F.col("n_sets") <= large)
    return same.unionByName(unsettled(with_others(storage.keep(split, "split"))))


def block_rows(rows: DataFrame, block_shingles: int) -> DataFrame:
    """``bucket, i, j, rep, root, asks``: the rows of each pair of blocks of a bucket.

    Sets outside the largest component of a bucket ask, all sets answer. ``i`` is the block of those that ask.
    """
    per_root = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    of_bucket = per_root.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("size").alias("all")
    )
    blocks = F.ceil(F.col("all") / block_shingles).cast("int")
    of_bucket = storage.keep(of_bucket.select("bucket", "largest", blocks.alias("blocks")), "blocks")
    rows = rows.join(of_bucket, "bucket").withColumns(
        {
            "own": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"),
            "all_blocks": F.sequence(F.lit(0), F.col("blocks") - 1),
        }
    )
    asking = rows.where(F.col("root") != F.col("largest")).select(
        "bucket", F.col("own").alias("i"), F.explode("all_blocks").alias("j"), "rep", "root", F.lit(True).alias("asks")
    )
    answering = rows.select(
        "bucket", F.explode("all_blocks").alias("i"), F.col("own").alias("j"), "rep", "root", F.lit(False).alias("asks")
    )
    return asking.unionByName(answering)


def joining_links(reps, roots, asks, sets, percent: int) -> list[tuple[int, int]]:
    """Links of one pair of blocks that join its components; a forest, not all links."""
    answering = [k for k, a in enumerate(asks) if not a]
    if not answering or len(answering) == len(asks):
        return []
    shingles = np.concatenate([sets[k] for k in answering])
    sizes = np.array([len(sets[k]) for k in answering])
    owner = np.repeat(np.arange(len(answering)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    label = np.array([roots[k] for k in answering])
    joined: dict[int, int] = {}  # a label: the one it has become
    found = []
    for k in (k for k, a in enumerate(asks) if a):
        low = np.searchsorted(shingles, sets[k], "left")
        counts = np.searchsorted(shingles, sets[k], "right") - low
        ends = np.cumsum(counts)
        places = np.arange(ends[-1]) + np.repeat(low - ends + counts, counts)
        both = np.bincount(owner[places], minlength=len(answering))
        near = 100 * both >= percent * (sizes + len(sets[k]) - both)
        own = roots[k]
        while own in joined:
            own = joined[own]
        for at in np.nonzero(near & (label != own))[0].tolist():
            if label[at] != own:
                found.append((reps[k], reps[answering[at]]))
                joined[int(label[at])] = own
                label[label == label[at]] = own
    return found


def block_links(rows: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of all pairs of blocks, by the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def links() -> pa.RecordBatch:
            found = joining_links(*held, percent)
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("band", "value", "i", "j")))
            rows = zip(*(batch.column(c).to_pylist() for c in ("rep", "root", "asks")), batch.column("shingles"))
            for new, (rep, root, asks, data) in zip(keys, rows):
                if new != key:
                    if key is not None:
                        yield links()
                    key, held = new, ([], [], [], [])
                values = np.frombuffer(data.as_py(), "<u8")
                for column, value in zip(held, (rep, root, asks, values)):
                    column.append(value)
        if key is not None:
            yield links()

    names = ["band", "value", "i", "j"]
    placed = rows.select("bucket.band", "bucket.value", "i", "j", "rep", "root", "asks").join(shingles, "rep")
    return placed.repartition(*names).sortWithinPartitions(*names).mapInArrow(compare, "a long, b long")


def links(
    docs: DataFrame, sets: DataFrame, shingle: int, percent: int, large: int = LARGE, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """Links ``a, b`` between sets whose components are those of all links."""
    rows = first_buckets(sets)

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = storage.keep(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
        shingles = full_sets(docs, sets, wanted.distinct(), shingle)
        return pairs, storage.keep(verified(pairs, shingles, percent), "links")

    tested, star = confirmed(star_pairs(rows, percent))
    rows = unsettled(with_roots(rows, star))
    _, small = confirmed(small_pairs(rows, percent).join(tested, ["a", "b"], "left_anti"))
    rows = split_large(rows.where(F.col("n_sets") > SMALL), sets, large)
    blocks = storage.keep(block_rows(rows, block_shingles), "blocks")
    shingles = full_sets(docs, sets, blocks.select("rep").distinct(), shingle)
    return star.unionByName(small).unionByName(block_links(blocks, shingles, percent))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, **limits
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    ``kept`` marks the rows with the smallest id of their component.
    """
    found = storage.keep(signed(docs, shingle, bands, rows), "signed")
    sets = distinct_sets(found)
    roots = components(links(docs, sets, shingle, percent, **limits)).withColumnRenamed("node", "rep")
    rooted = sets.select("rep", "set_key", F.col("first.doc_id").alias("doc_id")).join(roots, "rep", "left")
    rooted = storage.keep(rooted.withColumn("root", F.coalesce("root", "rep")), "rooted")
    lowest = storage.keep(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    of_set = storage.keep(rooted.select("set_key", "root").join(lowest, "root"), "classes")
    # apart, so that the rows without shingles don't meet in one partition
    some, none = found.where("set_key IS NOT NULL"), found.where("set_key IS NULL")
    some = some.join(of_set.select("set_key", "component_id"), "set_key")
    none = none.withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", "n_shingles", "component_id"]
    return (
        some.select(*names)
        .unionByName(none.select(*names))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
