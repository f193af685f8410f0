"""The keyword rule table: headers, requirements, suppressors and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import strip
from chatlens.operators.joins import contains_join, lookup_join
from chatlens.schemas import RULE_COLUMNS

# Fixed values of the header naming.
GENERIC = "generic"
GENERIC_SUFFIX = "_generic"


def header(brand: Column, product: Column) -> Column:
    return F.concat(brand, F.lit("_"), product)


def is_generic(headers: Column) -> Column:
    return F.contains(headers, F.lit(GENERIC))


def generic_base(headers: Column) -> Column:
    return F.replace(headers, F.lit(GENERIC_SUFFIX), F.lit(""))


def add_headers(rules: DataFrame) -> DataFrame:
    """Blank for null, then ``headers`` = brand + "_" + product. ``idx`` keeps the row order."""
    filled = rules.select(
        "idx", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RULE_COLUMNS]
    )
    return filled.withColumn("headers", header(F.col("brand"), F.col("product")))


def required_headers(rules: DataFrame) -> DataFrame:
    """One row per distinct (brand, required_product) and header asked for."""
    products = F.array_distinct(F.transform(F.split("required_product", ","), strip))
    return (
        rules.select("brand", "required_product")
        .distinct()
        .withColumn("_product", F.explode(products))
        .select(
            "brand",
            "required_product",
            header(F.col("brand"), F.col("_product")).alias("headers"),
        )
    )


def requirement_words(rules: DataFrame) -> DataFrame:
    """``brand, required_product, idx, keyword``: the keywords of each distinct requirement.

    A requirement has its keywords once, however many rules ask for it.
    """
    words = rules.select("headers", "idx", "keyword")
    return lookup_join(words, required_headers(rules), ["headers"]).select(
        "brand", "required_product", "idx", "keyword"
    )


def resolve_required(rules: DataFrame) -> DataFrame:
    """Look up, in the same table, the keywords of the products a rule asks for.

    Adds ``required_words`` (array, table order) and ``required_keyword`` (joined by ``|``), which each rule
    has a copy of. Tagging does without: see ``requirement_words``.
    """
    words = rules.select("headers", F.col("idx").alias("_idx"), "keyword")
    resolved = (
        words.join(required_headers(rules), "headers")
        .groupBy("brand", "required_product")
        .agg(F.array_sort(F.collect_list(F.struct("_idx", "keyword"))).alias("_words"))
        .select("brand", "required_product", F.col("_words.keyword").alias("required_words"))
    )
    return rules.join(resolved, ["brand", "required_product"], "left").select(
        "idx",
        *RULE_COLUMNS,
        "headers",
        F.coalesce("required_words", F.array().cast("array<string>")).alias("required_words"),
        F.coalesce(F.array_join("required_words", "|"), F.lit("")).alias("required_keyword"),
    )


def rules_of_header(rules: DataFrame, name: str) -> DataFrame:
    return rules.where(F.col("headers") == name)


def with_rule_kind(rules: DataFrame) -> DataFrame:
    """``kind``: simple without a resolved requirement, else complex."""
    blank = F.coalesce(F.col("required_keyword"), F.lit("")) == ""
    return rules.withColumn("kind", F.when(blank, "simple").otherwise("complex"))


def header_order(rules: DataFrame) -> DataFrame:
    """Distinct headers with the row of their first appearance."""
    return (
        rules.groupBy("headers")
        .agg(F.min("idx").cast("long").alias("ord"))
        .select(
            "headers",
            "ord",
            is_generic(F.col("headers")).alias("generic"),
            generic_base(F.col("headers")).alias("base"),
        )
    )


def suppressor_pairs(headers: DataFrame) -> DataFrame:
    """(generic header, specific header) where the base name occurs in the specific header."""
    generic = headers.where("generic").select("headers", "ord", "base")
    specific = headers.where(~F.col("generic")).select("headers", "ord")
    found = contains_join(specific, "headers", "headers", generic, "base")
    return (
        lookup_join(found.withColumnRenamed("headers", "specific"), generic, ["base"])
        .withColumnsRenamed({"headers": "generic", "ord": "generic_ord"})
        .join(
            specific.select(
                F.col("headers").alias("specific"), F.col("ord").alias("specific_ord")
            ),
            "specific",
        )
        .select("generic", "generic_ord", "specific", "specific_ord")
    )


def rules_json(rules: DataFrame) -> DataFrame:
    """All rules as one JSON array of records, in table order (one row, one column)."""
    fields = [*RULE_COLUMNS, "headers", "required_keyword"]
    records = F.transform(
        F.array_sort(F.collect_list(F.struct("idx", *fields))),
        lambda r: F.struct(*[r[f].alias(f) for f in fields]),
    )
    return rules.agg(F.to_json(records).alias("rules_json"))


def header_keywords(rules: DataFrame) -> DataFrame:
    """Per header its keywords and the single words of its requirements, sorted and joined."""
    required = F.when(
        F.col("required_keyword") != "", F.split("required_keyword", r"\|")
    ).otherwise(F.array().cast("array<string>"))
    words = rules.select(
        "headers", F.explode(F.concat(F.array("keyword"), required)).alias("word")
    ).distinct()
    return words.groupBy("headers").agg(
        F.array_join(F.array_sort(F.collect_list("word")), ", ").alias("keywords")
    )
