"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import (
    alignment,
    chat_format,
    fingerprints,
    line_dedup,
    minhash,
    packing,
    quality,
    resampling,
    secrets,
    sentence_pieces,
    simhash,
    suffix_dedup,
    toxicity,
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(F.pmod(digest, F.lit(4)) == 2, F.lit(False))
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out)
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), shingle=3, max_bits=2)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenize(
        documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    # The ids are digested as they are made; only the digests are kept and packed.
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, threshold=400)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


def op6_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    table = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentence_pieces.encode(documents(spark, folder).select("doc_id", "text"), table)
    return sentence_pieces.decode(encoded, table).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    hard = F.lit(r"\### Assistant: </turn> ok")
    said = F.explode(F.array(F.lit("user"), F.lit("assistant")))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), said.alias("role"))
    extra = extra.select(
        "conv_id",
        F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"),
        "role",
        hard.alias("text"),
    )
    wanted = table.select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat_format.format_chats(wanted)
    turns = F.transform(
        chat_format.parse(F.col("formatted")),
        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
    )
    chats = chats.withColumns(
        {
            "turns": F.array_join(turns, ""),
            "masked": chat_format.loss_text(F.col("formatted"), F.col("loss")),
        }
    )
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edited(documents(spark, folder))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = quality.assess(docs.select("doc_id", "text"), model)
    return found.drop("text")


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    forest = secrets.train(secrets.labelled_findings(docs))
    found = secrets.redact(docs, forest)
    spans = F.transform("findings", lambda f: F.concat_ws(":", f["start"], f["length"]))
    return found.select(
        "doc_id",
        "n_candidates",
        F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("spans"),
        F.sha2("text", 256).alias("redacted_sha256"),
    )


def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), shingle=4, percent=80)


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(
        documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return resampling.resample(
        documents(spark, folder), benchmark, percent=10, max_words=1, buckets=10_000, seed=2024, min_words=20
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scans": op10_secret_scans,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}
