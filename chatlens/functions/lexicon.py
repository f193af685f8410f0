"""Word-list sentiment: the written decision rule as one expression.

A few words are tested one by one inside the expression, longer lists by one search per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE_REASON = "only positive words"
NEGATIVE_REASON = "only negative words"
MIXED_REASON = "positive and negative words"
NEUTRAL_REASON = "no listed word"


def contains_any(folded: Column, words: list[str]) -> Column:
    tests = [F.contains(folded, F.lit(w)) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def sides_found(folded: Column, positive: list[str], negative: list[str]) -> Column:
    """``STRUCT<positive, negative>``: does a text contain a word of either list? One search for all words."""

    @F.pandas_udf("positive boolean, negative boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        side_of: dict[str, int] = {}
        for words, side in ((positive, 1), (negative, 2)):
            for word in words:
                side_of[word] = side_of.get(word, 0) | side
        # the blank word is in every text
        always = side_of.pop("", 0)
        search = ahocorasick.Automaton()
        for word, side in side_of.items():
            search.add_word(word, side)
        if len(search):
            search.make_automaton()

        def sides(text: str | None) -> int:
            if text is None:
                return 0
            seen = always
            for _, side in search.iter(text) if len(search) else ():
                seen |= side
                if seen == 3:
                    break
            return seen

        for texts in batches:
            seen = texts.map(sides, na_action=None).astype("int64")
            yield pd.DataFrame({"positive": (seen & 1) > 0, "negative": (seen & 2) > 0})

    return found(folded)


def lexicon_verdict(has_positive: Column, has_negative: Column) -> Column:
    """``STRUCT<sentiment, reason>``: P or N if only one side is present, else I."""
    return (
        F.when(
            has_positive & ~has_negative,
            F.struct(F.lit("P").alias("sentiment"), F.lit(POSITIVE_REASON).alias("reason")),
        )
        .when(
            has_negative & ~has_positive,
            F.struct(F.lit("N").alias("sentiment"), F.lit(NEGATIVE_REASON).alias("reason")),
        )
        .when(
            has_negative & has_positive,
            F.struct(F.lit("I").alias("sentiment"), F.lit(MIXED_REASON).alias("reason")),
        )
        .otherwise(
            F.struct(F.lit("I").alias("sentiment"), F.lit(NEUTRAL_REASON).alias("reason"))
        )
    )
