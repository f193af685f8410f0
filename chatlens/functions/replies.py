"""Strict reading of model replies, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions.text import let, strip
from chatlens.schemas import SENTIMENTS

OK = "ok"
BAD_JSON = "bad_json"
BAD_STRUCTURE = "bad_structure"
NOT_OBJECT = "not_object"
NO_TEXT = "no_text"

# Fixed value: the first fenced block of a reply.
FENCED_BLOCK = r"(?s)```(?:json)?(.*?)```"

# The error texts that end up in the Reason column, by JSON type of the reply.
NOT_OBJECT_REASONS = [
    ("ARRAY", "list indices must be integers or slices, not str"),
    ("STRING", "'str' object does not support item assignment"),
    ("BIGINT", "'int' object does not support item assignment"),
    ("BOOLEAN", "'bool' object does not support item assignment"),
    ("VOID", "'NoneType' object does not support item assignment"),
]
NOT_OBJECT_NUMBER = "'float' object does not support item assignment"


def reply_json(text: Column) -> Column:
    """The JSON part of a reply: the first fenced block, else the whole text."""
    part = let(
        F.regexp_extract(text, FENCED_BLOCK, 0),
        lambda block: F.when(block != "", F.regexp_extract(block, FENCED_BLOCK, 1)).otherwise(
            text
        ),
    )
    return strip(part)


def strict_json(part: Column) -> Column:
    """``{"v": value}`` as VARIANT, null unless ``part`` is exactly one JSON value.

    The value must parse both as the only element of an array and as the only member of an
    object; one wrapping alone would let trailing text through.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), part, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), part, F.lit("}")))
    return F.when(in_array.isNotNull(), in_object)


def parse_reply(text: Column) -> Column:
    """``STRUCT<status, sentiment, reason, error>`` of one reply.

    Each step is bound once (``let``), so that no text is parsed twice.
    """
    return F.when(text.isNull(), _outcome(NO_TEXT)).otherwise(
        let(let(reply_json(text), strict_json), _fields)
    )


def _outcome(
    status: str,
    sentiment: Column | None = None,
    reason: Column | None = None,
    error: Column | None = None,
) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(status).alias("status"),
        (nothing if sentiment is None else sentiment).alias("sentiment"),
        (nothing if reason is None else reason).alias("reason"),
        (nothing if error is None else error).alias("error"),
    )


def _fields(value: Column) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(value), r"^OBJECT<v: ([A-Z]+)", 1)
    return let(kind, lambda k: _read(value, k))


def _read(value: Column, kind: Column) -> Column:
    def text_at(path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(value, path, "string"))

    error = F.lit(NOT_OBJECT_NUMBER)
    for json_type, message in NOT_OBJECT_REASONS:
        error = F.when(kind == json_type, message).otherwise(error)

    def judged(pair: Column) -> Column:
        valid = pair["sentiment"].isin(SENTIMENTS) & pair["reason"].isNotNull()
        return F.when(
            F.coalesce(valid, F.lit(False)), _outcome(OK, pair["sentiment"], pair["reason"])
        ).otherwise(_outcome(BAD_STRUCTURE))

    pair = F.struct(
        text_at("$.v.sentiment").alias("sentiment"), text_at("$.v.reason").alias("reason")
    )
    return (
        F.when(value.isNull(), _outcome(BAD_JSON))
        .when(kind != "OBJECT", _outcome(NOT_OBJECT, error=error))
        .otherwise(let(pair, judged))
    )
