"""Text and date expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a case-insensitive regular expression treats as equal although
# lower-casing keeps them apart (variant, base form).
CASE_VARIANTS = [
    ("\u0131", "\u0069"),  # latin small letter dotless i
    ("\u017f", "\u0073"),  # latin small letter long s
    ("\u00b5", "\u03bc"),  # micro sign
    ("\u03c2", "\u03c3"),  # greek small letter final sigma
    ("\u03d0", "\u03b2"),  # greek beta symbol
    ("\u03f5", "\u03b5"),  # greek lunate epsilon symbol
    ("\u03d1", "\u03b8"),  # greek theta symbol
    ("\u0345", "\u03b9"),  # combining greek ypogegrammeni
    ("\u1fbe", "\u03b9"),  # greek prosgegrammeni
    ("\u03f0", "\u03ba"),  # greek kappa symbol
    ("\u03d6", "\u03c0"),  # greek pi symbol
    ("\u03f1", "\u03c1"),  # greek rho symbol
    ("\u03d5", "\u03c6"),  # greek phi symbol
    ("\u1fd3", "\u0390"),  # greek small letter iota with dialytika and oxia
    ("\u1fe3", "\u03b0"),  # greek small letter upsilon with dialytika and oxia
    ("\u1e9b", "\u1e61"),  # latin small letter long s with dot above
    ("\u1c80", "\u0432"),  # cyrillic small letter rounded ve
    ("\u1c81", "\u0434"),  # cyrillic small letter long-legged de
    ("\u1c82", "\u043e"),  # cyrillic small letter narrow o
    ("\u1c83", "\u0441"),  # cyrillic small letter wide es
    ("\u1c84", "\u0442"),  # cyrillic small letter tall te
    ("\u1c85", "\u0442"),  # cyrillic small letter three-legged te
    ("\u1c86", "\u044a"),  # cyrillic small letter tall hard sign
    ("\u1c87", "\u0463"),  # cyrillic small letter tall yat
    ("\u1c88", "\ua64b"),  # cyrillic small letter unblended uk
    ("\ufb05", "\ufb06"),  # latin small ligature long s t
]

# White space as Python's strip() sees it.
_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an outer expression is evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_case(text: Column | str, full: bool = False) -> Column:
    """Case-insensitive form of a text.

    The default lower-cases. ``full`` also merges the letters of ``CASE_VARIANTS`` and the dotted
    capital I, at several times the cost.
    """
    column = F.col(text) if isinstance(text, str) else text
    if not full:
        return F.lower(column)
    variants = "".join(v for v, _ in CASE_VARIANTS)
    bases = "".join(b for _, b in CASE_VARIANTS)
    return F.translate(F.lower(F.translate(column, "İ", "i")), variants, bases)


def strip(text: Column) -> Column:
    """Remove all kinds of white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def without_csv(name: Column) -> Column:
    """File name with every ``.csv`` taken out."""
    return F.replace(name, F.lit(".csv"), F.lit(""))


def day_first_date(text: Column | str, date_format: str = "d/M/yyyy") -> Column:
    """Day-first date, null where it does not parse."""
    column = F.col(text) if isinstance(text, str) else text
    return F.try_to_date(column, date_format)


def second_of_day(text: Column | str) -> Column:
    """``HH:MM:SS`` as seconds since midnight, null where it does not parse."""
    column = F.col(text) if isinstance(text, str) else text
    parsed = F.try_to_timestamp(column, F.lit("H:m:s"))
    return F.hour(parsed) * 3600 + F.minute(parsed) * 60 + F.second(parsed)


def decoded_path(encoded: Column) -> Column:
    """Readable form of the percent-encoded paths in ``_metadata``."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def all_columns_hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
