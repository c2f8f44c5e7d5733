"""Exact arithmetic, rounding and ratios.

Money is summed as whole minor units in BIGINT.  That keeps the hot aggregations on primitive
longs inside whole-stage codegen, makes sums independent of row order, and lets ANSI mode raise
on overflow instead of losing digits.  Decimals appear only in results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"
PERCENT = "decimal(18,1)"
# Wide enough for any ratio, and six places is where two engines still agree on a double.
RATIO = "decimal(38,6)"


def int_div(value: Column, by: int) -> Column:
    """Integer division; ``/`` on two integers would give a double."""
    return F.call_function("div", value, F.lit(by))


def minor_units(amount: Column) -> Column:
    """A two-decimal DOUBLE amount as whole cents.

    Floor of a shifted double stays in generated code; a cast to DECIMAL formats every value as
    text first.  An amount that is not finite, or too large for its cents to be exact, raises.
    """
    cents = F.floor(amount * F.lit(100.0) + F.lit(0.5))
    exact = F.abs(amount) <= F.lit(9e13)  # NaN counts as larger than any number
    wrong = F.raise_error(F.concat(F.lit("no exact amount: "), amount.cast("string"))).cast("bigint")
    return F.when(amount.isNull() | exact, cents).otherwise(wrong)


def money(cents: Column) -> Column:
    """Whole cents as an exact two-decimal amount."""
    return (cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL where the divisor is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to one place, ties to even; NULL where the divisor is zero."""
    share = F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))
    return F.bround(share.cast(RATIO), 1).cast(PERCENT)


def rounded(value: Column, places: int) -> Column:
    """SQL ROUND (ties away from zero), taken on a decimal so that every engine agrees."""
    return F.round(value.cast(RATIO), places).cast(f"decimal(18,{places})")


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over the rows that have both values; NULL when either side does not vary.

    The built-in ``corr`` raises on zero variance under ANSI.
    """
    xs = F.when(y.isNotNull(), x.cast("double"))
    ys = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def clamp(value: Column, low: int, high: int) -> Column:
    """Bound a value; unlike a bare greatest/least, a NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))
