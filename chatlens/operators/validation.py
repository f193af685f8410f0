"""Declared checks on tables: presence, type, nulls; warnings for odd rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.schemas import EXPORT_COLUMNS, RULE_COLUMNS, SchemaError

NOT_NULL = "not_null"
BLANK_KEYWORD = "blank_keyword"
UNRESOLVED = "unresolved_required_product"


def check_columns(df: DataFrame, required: list[str], coerced: list[str] | None = None) -> None:
    """Raise unless all columns are there and are text (``coerced`` ones may be anything)."""
    missing = [c for c in required if c not in df.columns]
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    wrong = [
        c
        for c in required
        if c in types and c not in (coerced or []) and not isinstance(types[c], T.StringType)
    ]
    if missing or wrong:
        raise SchemaError(f"missing columns {missing}, columns that are not text {wrong}")


def check_chats(df: DataFrame) -> DataFrame:
    check_columns(df, EXPORT_COLUMNS, coerced=["userPhone"])
    return df


def check_rules(df: DataFrame) -> DataFrame:
    if "idx" not in df.columns:
        raise SchemaError("the rule table needs idx, the order of its rows")
    check_columns(df, RULE_COLUMNS)
    return df


def null_violations(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``keys, column, rule`` for every null in a column that must not have one."""
    found = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.select(*keys, F.explode(found).alias("column")).withColumn(
        "rule", F.lit(NOT_NULL)
    )


def rule_warnings(rules: DataFrame) -> DataFrame:
    """``idx, column, rule`` for resolved rules that match more than they seem to.

    A blank keyword matches every message; a requirement that finds no product makes the rule
    unconditional.
    """
    checks = [
        (F.col("keyword") == "", "keyword", BLANK_KEYWORD),
        (
            (F.col("required_product") != "") & (F.size("required_words") == 0),
            "required_product",
            UNRESOLVED,
        ),
    ]
    return reduce(
        DataFrame.union,
        [
            rules.where(condition).select(
                "idx", F.lit(column).alias("column"), F.lit(rule).alias("rule")
            )
            for condition, column, rule in checks
        ],
    )
