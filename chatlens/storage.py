"""The shared folder for tables that cut lineage or pass through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the session's warehouse.

    A local warehouse on a real cluster is refused: each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.conf.get("spark.sql.warehouse.dir")
    local = folder.startswith("file:") or "://" not in folder
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir: executors do not share {folder}")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that does not exist yet, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/chatlens/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and later steps read only the columns they
    need.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_kept(spark: SparkSession) -> None:
    """Delete all that ``keep`` and ``new_folder`` left; results not yet computed become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/chatlens")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
