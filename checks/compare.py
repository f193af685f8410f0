"""Run every query next to its SQL and compare the rows: ``python -m checks.compare [sf] [name…]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(pdf: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, nulls as None."""
    columns = sorted(pdf.columns)
    rows = [
        tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in row)
        for row in pdf[columns].itertuples(index=False, name=None)
    ]
    return sorted(rows, key=repr)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str:
    """Blank if both sides agree."""
    ours = QUERIES[name](spark, folder).toPandas()
    theirs = con.execute(ORACLE[name]).fetch_df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    a, b = normal(ours), normal(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"[:600]
    return ""


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    failed = 0
    for name in args[1:] or QUERIES:
        start = time.time()
        try:
            found = difference(spark, con, name, folder)
        except Exception as e:
            found = f"{type(e).__name__}: {e}"[:900]
        rows = "" if found else "ok"
        print(f"{name:24} {time.time() - start:6.2f}s {rows}{found}", flush=True)
        failed += bool(found)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main())
