"""Changes of a table as rows: the row as it was with ``_change`` -1, the row as it is now with +1.

A changed row is both, a new one only the second, a deleted one only the first.  Sums over a table follow its
delta: each row's share is taken off or added.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "_change"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn(CHANGE, F.lit(sign))


def delta_of(before: DataFrame, after: DataFrame) -> DataFrame:
    """The delta that leads from one state to another, repeated rows included: all rows are compared."""
    return signed(before.exceptAll(after), -1).unionByName(signed(after.exceptAll(before), 1))


def applied(rows: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``rows`` after the delta.  Applying it a second time changes nothing.

    A row is known by its key, which is not NULL; where several rows have one key, the delta must hold all of them.
    """
    untouched = rows.join(delta.select(key).distinct(), key, "left_anti")
    return untouched.select(*rows.columns).unionByName(delta.where(f"{CHANGE} = 1").select(*rows.columns))


def joined_delta(first: DataFrame, first_delta: DataFrame, second: DataFrame, second_delta: DataFrame, on: str):
    """Delta of the inner join of two tables, given both as they are now and their deltas.

    The first's delta meets the second as it was, which is the second as it is now less its delta; the
    second's delta meets the first as it is now.  Only ``on`` may be named alike.
    """
    was = signed(second, 1).unionByName(second_delta.withColumn(CHANGE, -F.col(CHANGE)))
    left = first_delta.join(was.withColumnRenamed(CHANGE, "_other"), on)
    left = left.withColumn(CHANGE, F.col(CHANGE) * F.col("_other")).drop("_other")
    return left.unionByName(first.join(second_delta, on))


def _known(column: str) -> str:
    return f"{column}_known"


def sums(columns: Iterable[str]) -> list[Column]:
    """Per column the sum over a delta, and of how many values it is one: a sum of no values is NULL."""
    change = F.col(CHANGE)
    return [
        part
        for c in columns
        for part in (
            F.coalesce(F.sum(change * F.col(c)), F.lit(0)).alias(c),
            F.coalesce(F.sum(F.when(F.col(c).isNotNull(), change)), F.lit(0)).cast("bigint").alias(_known(c)),
        )
    ]


def value_of(column: str) -> Column:
    """The sum that a state holds, as SQL's SUM gives it."""
    return F.when(F.col(_known(column)) > 0, F.col(column))
