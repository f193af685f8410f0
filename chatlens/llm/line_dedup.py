"""Line dedup against levelled, sorted runs of line hashes.

Documents come in batches in ascending order of ``doc_id``. The line keys of a batch are hashed,
reduced to one row per hash and merge-joined with the runs, which hold the hashes of all earlier
batches. Hashes that no run has become the batch's own run. ``fanout`` runs of a level are
compacted into one run of the next level, so there are only logarithmically many. Runs are tables
bucketed and sorted by hash: a batch shuffles its own hashes once, the runs not at all.

A line is dropped if its key is in an earlier run, or if a smaller ``doc_id`` of the batch has it.

Cases: a null text counts as an empty one (one empty line); rows with the same ``doc_id`` are parts
of one document; a null ``doc_id`` is one document after all others, in the last batch; repeated
rows are all kept and treated alike; a document that loses all lines keeps the empty text; other
columns pass through, and replace nothing: the operator's own columns are named by ``PREFIX``
inside and the results ``text``, ``n_lines`` and ``n_dropped`` override columns of these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import storage
from chatlens.llm.common import WHITE, ascii_lower, let, shuffle_partitions

NEWLINE = "\n"
PREFIX = "_line_"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class LineRuns:
    """The runs so far, and the step that takes one more batch."""

    def __init__(self, spark: SparkSession, min_chars: int = 10, fanout: int = 2):
        self.spark = spark
        self.min_chars = min_chars
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """The batch without the lines that it or an earlier batch already had.

        ``batch`` needs ``doc_id`` and ``text``. Hashes are written here; the result is lazy.
        """
        self._compact()
        lines = self._lines(batch)
        owners = lines.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("owner"),
            F.max("doc_id").alias("last"),
            F.max(F.col("doc_id").isNull()).alias("nameless"),
        )
        shared = (F.col("owner") != F.col("last")) | (
            F.col("nameless") & F.col("owner").isNotNull()
        )
        seen = F.lit(False)
        for i, run in enumerate(run for level in self.levels for run in level):
            mark = f"run{i}"
            owners = owners.join(
                run.select("h1", "h2", F.lit(True).alias(mark)), ["h1", "h2"], "left"
            )
            seen = seen | F.coalesce(F.col(mark), F.lit(False))
        table, folder = self._write(
            owners.select("h1", "h2", "owner", shared.alias("shared"), seen.alias("seen"))
        )
        self._push(0, table.where(~F.col("seen")).select("h1", "h2"))
        # Read as files, not as a bucketed table: only then can Spark split a very common line.
        schema = "h1 long, h2 long, owner " + batch.schema["doc_id"].dataType.simpleString()
        found = self.spark.read.schema(schema + ", shared boolean, seen boolean").parquet(folder)
        twice = found.where(F.col("seen") | F.col("shared")).select("h1", "h2", "owner", "seen")
        return without_lines(batch, lines, twice)

    def _lines(self, batch: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        lines = batch.select(
            "doc_id",
            F.xxhash64(text).alias("text_hash"),
            F.posexplode(F.split(text, NEWLINE)).alias("pos", "line"),
        ).withColumn("line", line_key(F.col("line")))
        return lines.where(F.char_length("line") >= self.min_chars).select(
            "doc_id",
            "text_hash",
            "pos",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(1), "line").alias("h2"),
        )

    def _write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        name = f"line_run_{uuid.uuid4().hex}"
        folder = storage.new_folder(self.spark, name)
        (
            rows.write.format("parquet")
            .bucketBy(shuffle_partitions(rows), "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", folder)
            .saveAsTable(name)
        )
        return self.spark.table(name), folder

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                merged = runs[0]
                for run in runs[1:]:
                    merged = merged.unionByName(run)
                merged = merged.repartition(shuffle_partitions(merged), "h1", "h2")
                self.levels[level] = []
                self._push(level + 1, self._write(merged)[0])


def without_lines(batch: DataFrame, lines: DataFrame, twice: DataFrame) -> DataFrame:
    """The batch without the lines whose key is in ``twice`` and not owned by their document."""
    dropped = (
        lines.join(twice, ["h1", "h2"])
        .where(F.col("seen") | ~F.col("doc_id").eqNullSafe(F.col("owner")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias(f"{PREFIX}pos"))
        .select(
            F.col("doc_id").alias(f"{PREFIX}id"),
            F.col("text_hash").alias(f"{PREFIX}hash"),
            f"{PREFIX}pos",
        )
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    pos = F.col(f"{PREFIX}pos")

    def rest(parts: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(pos, lambda p: p + 1))
        ends = F.concat(pos, F.array(F.size(parts)))
        between = F.zip_with(starts, ends, lambda s, e: F.slice(parts, s + 1, e - s))
        return F.array_join(F.flatten(between), NEWLINE)

    joined = batch.join(
        dropped,
        batch["doc_id"].eqNullSafe(F.col(f"{PREFIX}id"))
        & (F.xxhash64(text) == F.col(f"{PREFIX}hash")),
        "left",
    )
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit(NEWLINE), F.lit(""))) + 1
    return joined.withColumns(
        {
            "n_lines": n_lines.cast("long"),
            "n_dropped": F.coalesce(F.size(pos), F.lit(0)).cast("long"),
            "text": F.when(pos.isNull(), text).otherwise(let(F.split(text, NEWLINE), rest)),
        }
    ).drop(f"{PREFIX}id", f"{PREFIX}hash", f"{PREFIX}pos")


def batch_bounds(docs: DataFrame, batches: int) -> list:
    """Upper ends of all batches but the last, so that these are about equal in rows."""
    cuts = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 10_000).alias("b")).head()["b"]
    return sorted(set(found or []))


def dedup_lines(
    docs: DataFrame, batches: int = 4, min_chars: int = 10, fanout: int = 2
) -> DataFrame:
    """All documents, each line key of ``min_chars`` code points left only in the smallest doc_id."""
    runs = LineRuns(docs.sparkSession, min_chars, fanout)
    bounds = batch_bounds(docs, batches)
    ident, result = F.col("doc_id"), None
    for low, high in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True) if low is None else (ident > low)
        if high is not None:
            inside = inside & (ident <= high)
        elif low is not None:
            inside = inside | ident.isNull()
        part = runs.add(docs.where(inside))
        result = part if result is None else result.unionByName(part)
    return result
