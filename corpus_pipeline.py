"""The corpus pipeline: stages that each call one operator of ``chatlens.llm``.

Every stage takes what its predecessor kept. All but the last return the columns of the documents;
``n_chars`` follows the text where a stage changes it; other columns stay as they are, whatever their names. Nulls, empty tables, repeated rows and other
columns are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import storage
from chatlens.llm import line_dedup, packing, quality, secrets, simhash


def _with_new_texts(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs``, with the texts that ``change`` makes and ``n_chars`` of these.

    All other columns pass through it in one struct, so that what it adds never meets a column of theirs.
    """
    own = F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    changed = change(docs.select("doc_id", "text", own.alias("_doc")))

    def column(name: str) -> Column:
        if name == "text":
            return F.col(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.coalesce(F.char_length("text"), F.lit(0)).cast(kind).alias(name)
        return F.col("_doc").getField(name).alias(name)

    return changed.select(*[column(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id already has go."""
    return _with_new_texts(docs, line_dedup.dedup_lines)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return simhash.one_per_class(docs, shingle=3, max_bits=2)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    forest = secrets.train(secrets.labelled_findings(docs))
    return _with_new_texts(docs, lambda rows: secrets.redact(rows, forest))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in training sequences."""
    pieces = packing.tokenize(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Trees, a forest, majority fingerprints and the packing plan are beyond SQL; tests compare each
#: stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
