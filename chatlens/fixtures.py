"""Test inputs: the driver's tables seen as chats, and small rule tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (idx, brand, product, keyword, required_product)
RULES = [
    (0, "thal", "one", "thtion", "two"),
    (1, "thal", "one", "onthsh", ""),
    (2, "thal", "two", "erhe", ""),
    (3, "thal", "two", "THNT", ""),
    (4, "thal", "generic", "ndly", ""),
    (5, "enor", "pro", "euxque", "max, lite"),
    (6, "enor", "max", "étion", ""),
    (7, "enor", "lite", "Èvi", ""),
    (8, "enor", "generic", "aupa", ""),
    (9, "enor", "pro", "ouvi", "nosuch"),
    (10, "solo", "generic", "enheit", ""),
    (11, "thalia", "one", "asción", ""),
]
RULE_SCHEMA = "idx int, brand string, product string, keyword string, required_product string"

# (idx, gus_id, group_nature)
GROUP_INFO = [
    (0, "grp0", "mums"),
    (1, "grp1", "old"),
    (2, "grp2", "deals"),
    (3, "grp3", "X"),
    (4, "grp1", "mums"),
    (5, "grp5", None),
    (6, "grp9", "deals"),
]
GROUP_INFO_SCHEMA = "idx int, gus_id string, group_nature string"

POSITIVE = ["onti", "erat", "ción"]
NEGATIVE = ["ernt", "thed", "erung"]

# Reply texts with the status each must get.
REPLIES = [
    ('{"sentiment":"P","reason":"good"}', "ok"),
    ('```json\n{"sentiment":"N","reason":"bad"}\n```', "ok"),
    ('text ```{"sentiment":"I","reason":"q"}``` more', "ok"),
    ('{"sentiment":"P","reason":"x"} trailing', "bad_json"),
    ('{"sentiment":"P","reason":"x"}] tail', "bad_json"),
    ('{"sentiment":"P","reason":"x"}} tail', "bad_json"),
    ('{"sentiment":"p","reason":"x"}', "bad_structure"),
    ('{"sentiment":"P","reason":5}', "bad_structure"),
    ('{"sentiment":"P"}', "bad_structure"),
    ('["P"]', "not_object"),
    ("", "bad_json"),
    ('{"sentiment":"N","reason":"é","extra":[1],"success":false}', "ok"),
    ("{'sentiment':'P','reason':'x'}", "bad_json"),
    ('```json {"sentiment":"P","reason":"x"}', "bad_json"),
    ("null", "not_object"),
]


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as constants of the plan."""
    table = pa.Table.from_pylist(
        [dict(zip(schema_names(schema), r)) for r in rows],
        schema=pa.schema(
            [(n, pa.int32() if n == "idx" else pa.string()) for n in schema_names(schema)]
        ),
    )
    return spark.createDataFrame(table)


def schema_names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def rules(spark: SparkSession) -> DataFrame:
    return inline_table(spark, RULES, RULE_SCHEMA)


def group_info(spark: SparkSession) -> DataFrame:
    return inline_table(spark, GROUP_INFO, GROUP_INFO_SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conversation_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chat exports, with ``conv_id`` and ``turn`` in front."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int"))
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("grp"), F.col("conv_id") % 6).alias("Source"),
        F.date_format(day, "yyyy-MM-dd").alias("Date1"),
        F.date_format(day, "dd/MM/yyyy").alias("Date2"),
        F.format_string("%02d:%02d:00", F.col("turn") + 8, F.col("conv_id") % 60).alias("Time"),
        F.col("role").alias("userPhone"),
        nothing.alias("quotedMessage"),
        F.col("text").alias("messageBody"),
        F.when(F.col("turn") % 4 == 3, "image").alias("mediaType"),
        nothing.alias("mediaCaption"),
    )


def export_slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two overlapping exports: all columns, and reversed columns without ``mediaCaption``."""
    base = conversation_exports(spark, sf_dir)
    first = base.where("turn <= 4").drop("conv_id", "turn")
    second = base.where("turn >= 3").drop("conv_id", "turn", "mediaCaption")
    return [first, second.select(*reversed(second.columns))]


def document_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages, with ``doc_id`` in front."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("Source"),
        F.col("lang").alias("userPhone"),
        F.col("text").alias("messageBody"),
    )


def event_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as chats, one per user."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("user"), F.col("user_id")).alias("Source"),
        F.date_format("ts", "dd/MM/yyyy").alias("Date2"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        F.col("event_type").alias("messageBody"),
    )


def customer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as group info for ``event_exports``; every tenth nature is one character."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("idx"),
        F.concat(F.lit("user"), F.col("c_custkey") % 700).alias("gus_id"),
        F.when(F.col("c_custkey") % 10 == 0, "Z")
        .otherwise(F.col("c_mktsegment"))
        .alias("group_nature"),
    )


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a keyword table that grows with the data: about 40 rules per brand."""
    brand = F.concat(F.lit("b"), F.floor(F.col("p_partkey") / 40))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("idx"),
        brand.alias("brand"),
        F.when(F.col("p_type") == "STANDARD", "generic")
        .otherwise(F.lower("p_type"))
        .alias("product"),
        F.when(F.col("p_partkey") % 97 == 0, "")
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_size")))
        .alias("keyword"),
        F.when(F.col("p_partkey") % 5 == 0, "small, economy ")
        .when(F.col("p_partkey") % 7 == 0, "nosuch")
        .alias("required_product"),
    )


def _short_word(text: Column) -> Column:
    """The first of the shortest words with at least five characters, out of the whole text."""
    words = F.filter(F.split(text, " "), lambda w: F.char_length(w) >= 5)
    sized = F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    return F.coalesce(F.array_min(sized)["w"], text)


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a keyword table that grows with the data and occurs in messages."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.cast("int").alias("idx"),
        F.concat(F.lit("d"), F.floor(doc / 30)).alias("brand"),
        F.when(doc % 6 == 0, "generic")
        .otherwise(F.concat(F.lit("p"), doc % 6))
        .alias("product"),
        _short_word(F.col("text")).alias("keyword"),
        F.when(doc % 5 == 0, "p2, p3").otherwise("").alias("required_product"),
    )


def reply_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as model replies of all kinds, with the message text as reason."""
    kind = (F.col("conv_id") * 5 + F.col("turn")) % len(REPLY_FORMS)
    reason = F.regexp_replace("text", "[^A-Za-z ]", " ")
    text = F.lit(None).cast("string")
    for i, form in enumerate(REPLY_FORMS):
        before, _, after = form.partition("{reason}")
        filled = F.concat(F.lit(before), reason, F.lit(after)) if "{reason}" in form else F.lit(form)
        text = F.when(kind == i, filled).otherwise(text)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when((F.col("conv_id") + F.col("turn")) % 9 != 0, text).alias("reply"),
    )


# The replies above with the reason left open where there is one.
REPLY_FORMS = [
    '{"sentiment":"P","reason":"{reason}"}',
    '```json\n{"sentiment":"N","reason":"{reason}"}\n```',
    'text ```{"sentiment":"I","reason":"{reason}"}``` more',
    '{"sentiment":"P","reason":"{reason}"} trailing',
    '{"sentiment":"P","reason":"{reason}"}] tail',
    '{"sentiment":"P","reason":"{reason}"}} tail',
    '{"sentiment":"p","reason":"{reason}"}',
    '{"sentiment":"P","reason":5}',
    '{"sentiment":"P"}',
    '["{reason}"]',
    "",
    '{"sentiment":"N","reason":"{reason}","extra":[1],"success":false}',
    "{'sentiment':'P','reason':'{reason}'}",
    '```json {"sentiment":"P","reason":"{reason}"}',
    "null",
]


class ScriptedScorer:
    """A stand-in for a model whose reply is a function of the request alone."""

    def __call__(self, conversations: list[list[dict]]) -> list[str | None]:
        return [self.reply(c) for c in conversations]

    @staticmethod
    def reply(conversation: list[dict]) -> str | None:
        size = len(conversation[1]["content"])
        good = '{"sentiment":"%s","reason":"size %d"}' % ("PNI"[size % 3], size)
        if size % 5 == 0:
            return good if len(conversation) > 2 else "not json"
        if size % 5 == 1:
            return '["P"]'
        if size % 5 == 2:
            return None
        return good
