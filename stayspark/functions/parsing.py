"""Text to typed values; whatever does not parse becomes NULL, never an aborted job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a raw field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Year-month-day with optional leading zeros.
DATE_SHAPE = r"^(?!0000)\d{4}-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])$"
# A signed whole number; single underscores may group digits.
INTEGER_SHAPE = r"^[+-]?\d+(_\d+)*$"

KINDS = ("int", "str", "bool", "date")


def strip(raw: Column) -> Column:
    return F.trim(raw, F.lit(WHITESPACE))


def parse_int(raw: Column) -> Column:
    text = strip(raw)
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text.rlike(INTEGER_SHAPE), digits.try_cast("bigint"))


def parse_flag(raw: Column) -> Column:
    """``0``, ``1`` and any casing of true/false."""
    text = F.lower(strip(raw))
    return F.when(text.isin("1", "true"), 1).when(text.isin("0", "false"), 0).cast("int")


def parse_date(raw: Column) -> Column:
    text = strip(raw)
    return F.when(text.rlike(DATE_SHAPE), text.try_cast("date"))


def parse(raw: Column, kind: str) -> Column:
    if kind == "int":
        return parse_int(raw)
    if kind == "bool":
        return parse_flag(raw)
    if kind == "date":
        return parse_date(raw)
    if kind == "str":
        return strip(raw)
    raise ValueError(f"unknown kind {kind!r}, expected one of {KINDS}")


def parse_name(raw: Column, names: Iterable[str]) -> Column:
    """A table name typed in any casing, NULL when there is no such table."""
    name = F.initcap(strip(raw))
    return F.when(name.isin(*names), name)
