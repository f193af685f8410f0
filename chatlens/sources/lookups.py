"""The keyword table and the group-info table, from CSV or Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.schemas import GROUP_INFO_COLUMNS, RULE_COLUMNS, SchemaError
from chatlens.sources.csv_files import scan_csv


def _scan_lookup(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read a lookup and keep the order of its rows in ``idx``: by file name, then place.

    A lookup may have several part files. One small count per file turns the place in a file into
    a dense number over all files.
    """
    if path.endswith(".csv"):
        rows = scan_csv(spark, path, recursive=False, bad_files="fail", positions=True)
    elif path.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"{path}: the lookup must be a .csv or .parquet file")
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise SchemaError(f"{path}: missing columns {missing}")
    if "idx" in rows.columns:
        return rows.select(F.col("idx").cast("long").alias("idx"), *columns)
    if path.endswith(".parquet"):
        place = F.col("_metadata.row_index")
        rows = rows.select(F.col("_metadata.file_path").alias("_file"), place.alias("_place"), *columns)
    else:
        rows = rows.select(F.col("path").alias("_file"), F.col("_pos").alias("_place"), *columns)
    files = rows.groupBy("_file").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    # One row per file of the lookup.
    before = F.sum("_rows").over(Window.orderBy("_file")) - F.col("_rows") - F.col("_first")
    starts = files.select("_file", before.alias("_start"))
    return rows.join(starts, "_file").select((F.col("_place") + F.col("_start")).alias("idx"), *columns)


def scan_keywords(spark: SparkSession, path: str) -> DataFrame:
    return _scan_lookup(spark, path, RULE_COLUMNS)


def scan_group_info(spark: SparkSession, path: str) -> DataFrame:
    return _scan_lookup(spark, path, GROUP_INFO_COLUMNS)
