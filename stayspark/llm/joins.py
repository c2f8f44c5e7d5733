"""Joins with a side whose rows have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a few numbers or short strings: some 20 MB at most in a task's hash table.
BROADCAST_ROWS = 200_000


def sized(side: DataFrame, rows: int) -> DataFrame:
    """``side``, broadcast where its counted rows are few, else left to a shuffled join.

    The joined rows are the same either way.  Beyond the bound, adaptive execution splits the
    partitions of hot keys of the other side.
    """
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side.hint("merge")
