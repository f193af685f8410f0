"""Table layouts. Every value is text; dates and times are parsed only for sorting."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their order.
EXPORT_COLUMNS = [
    "Date1",
    "Date2",
    "Time",
    "userPhone",
    "quotedMessage",
    "messageBody",
    "mediaType",
    "mediaCaption",
]
CHAT_COLUMNS = ["Source", "Group", *EXPORT_COLUMNS, "Reason"]
RULE_COLUMNS = ["brand", "product", "keyword", "required_product"]
GROUP_INFO_COLUMNS = ["gus_id", "group_nature"]

# Columns that may not hold nulls.
EXPORT_NOT_NULL = ["Date2", "Time", "userPhone"]
RULE_NOT_NULL = ["brand", "product", "keyword"]

SENTIMENTS = ["P", "N", "I"]

HIT = T.StructType(
    [
        T.StructField("ord", T.LongType(), False),
        T.StructField("header", T.StringType(), False),
    ]
)
HITS = T.ArrayType(HIT, False)

RESULT = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("header", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
RESULTS = T.ArrayType(RESULT)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


class SchemaError(ValueError):
    """A table lacks a required column or a column has the wrong type."""
