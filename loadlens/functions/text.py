"""Text building where a missing part counts as empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character no pattern holds: LIKE then has no escape at all.
_NO_ESCAPE = "\x01"


def _part(value: Column | str) -> Column:
    if isinstance(value, str):
        return F.lit(value)
    return F.coalesce(value.cast("string"), F.lit(""))


def text_cat(*parts: Column | str) -> Column:
    """Joined text; plain strings are literals, NULL columns add nothing."""
    return F.concat(*[_part(p) for p in parts])


def range_text(low: Column, high: Column, sep: str = "-") -> Column:
    return text_cat(low, sep, high)


def indent(depth: Column, width: int = 1) -> Column:
    return F.repeat(F.lit(" "), (F.coalesce(depth, F.lit(0)) * F.lit(width)).cast("int"))


def _hundredths(cents: Column, whole: Column) -> Column:
    size = F.abs(cents)
    sign = F.when(cents < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def number_text(cents: Column) -> Column:
    """A number given in hundredths as its shortest text: ``12``, ``0.5``, ``3.07``."""
    whole = F.call_function("div", F.abs(cents), F.lit(100)).cast("string")
    return F.regexp_replace(_hundredths(cents, whole), r"\.?0+$", "")


def grouped_text(cents: Column) -> Column:
    """A number given in hundredths with two decimals and blanks between thousands: ``1 234.50``."""
    whole = F.call_function("div", F.abs(cents), F.lit(100))
    return _hundredths(cents, F.translate(F.format_number(whole, 0), ",", " "))


def like(column: Column, pattern: str, escape: str | None = None) -> Column:
    """SQL LIKE that has an escape character only when one is given."""
    return F.like(column, F.lit(pattern), F.lit(escape or _NO_ESCAPE))


def count_set_flags(flag: str) -> Column:
    """Rows whose Y/N flag is neither N nor NULL."""
    return F.count(F.nullif(F.col(flag), F.lit("N")))
