"""Where two builds of a table differ, found from sums over ranges of keys.

A tree holds row count and content sums of every range of ``width`` keys, of every 256 ranges, and so on up to
the root.  It is made once per build, in one pass.  Two trees are compared from the root down; only rows of the
ranges that differ need be read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import int_div
from stayspark.operators.deltas import CHANGE, signed
from stayspark.sources.slices import Sliced

# A range has 2**BITS ranges below it; LEVELS of them reach over any BIGINT.
BITS = 8
LEVELS = 8
_SUMS = ("row_count", "sum_1", "sum_2")


def _content(columns: Sequence[str]) -> list[Column]:
    """One, and two hashes of a row; NULL flags are hashed too, as hashes skip NULLs."""
    cells = [F.col(f"`{c}`") for c in columns]
    flags = [cell.isNull() for cell in cells]
    hashes = [F.xxhash64(*cells, *flags), F.xxhash64(F.lit(1), *flags, *cells)]
    return [F.lit(1).cast("bigint").alias("row_count")] + [
        h.cast("decimal(20,0)").alias(name) for h, name in zip(hashes, _SUMS[1:], strict=True)
    ]


def _added() -> list[Column]:
    kinds = ("bigint", "decimal(38,0)", "decimal(38,0)")
    return [F.sum(name).cast(kind).alias(name) for name, kind in zip(_SUMS, kinds, strict=True)]


def content_tree(table: DataFrame, key: str, width: int) -> DataFrame:
    """(level, range, row_count, sum_1, sum_2) of all ranges; level 0 has ranges of ``width`` keys.

    Rows without a key are a range of their own, NULL, on every level.  The sums depend neither on row order
    nor on partitioning, and rows are folded before the shuffle.
    """
    number = int_div(F.col(f"`{key}`").cast("bigint"), width)
    leaves = table.select(number.alias("range"), *_content(table.columns)).groupBy("range").agg(*_added())
    above = F.array(*[
        F.struct(F.lit(level).alias("level"), F.shiftright("range", BITS * level).alias("range"))
        for level in range(LEVELS)
    ])
    return (
        leaves.select(F.inline(above), *_SUMS).toDF("level", "range", *_SUMS).groupBy("level", "range").agg(*_added())
    )


def _unequal(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys whose sums differ, with the row counts of both sides."""
    both = signed(first, 1).unionByName(signed(second, -1))
    mine, theirs = F.col(CHANGE) > 0, F.col(CHANGE) < 0
    gaps = [F.sum(F.col(name) * F.col(CHANGE)).alias(name) for name in _SUMS]
    counts = [
        F.coalesce(F.sum(F.when(side, F.col("row_count"))), F.lit(0)).alias(name)
        for side, name in ((mine, "first_rows"), (theirs, "second_rows"))
    ]
    grouped = both.groupBy(key).agg(*gaps, *counts)
    return grouped.where(" OR ".join(f"{name} <> 0" for name in _SUMS)).select(key, "first_rows", "second_rows")


def _first_level(first: DataFrame, second: DataFrame) -> int:
    """The lowest level of so few ranges that looking at the levels above saves nothing."""
    ranges = first.unionByName(second).groupBy("level").agg(F.countDistinct("range").alias("n"))
    few = [row["level"] for row in ranges.where(F.col("n") <= 2**BITS).collect()]  # at most LEVELS rows
    return min(few, default=LEVELS - 1)


def differing_ranges(first: DataFrame, second: DataFrame) -> DataFrame:
    """``range`` of the lowest level whose content differs between two trees of the same width.

    Both are read level by level, from the first with at most 256 ranges; below it only where ranges differ.
    """
    wanted = None
    for level in reversed(range(_first_level(first, second) + 1)):
        sides = []
        for tree in (first, second):
            side = tree.where(F.col("level") == level).select("range", *_SUMS)
            if wanted is not None:
                parent = F.shiftright("range", BITS)
                side = side.join(wanted, parent.eqNullSafe(F.col("parent")), "left_semi")
            sides.append(side)
        found = _unequal(*sides, "range").select("range")
        wanted = found.select(F.col("range").alias("parent"))
    return found


def differing_keys(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, change, first_rows, second_rows): keys that are ``lost``, ``new``, or whose rows ``changed``.

    A row that moved to another key is lost under the one and new under the other.  A key's rows are compared as a
    whole and in no order; both frames have the same columns.
    """
    sides = [frame.select(F.col(f"`{key}`").alias("key"), *_content(first.columns)) for frame in (first, second)]
    change = F.when(F.col("second_rows") == 0, "lost").when(F.col("first_rows") == 0, "new").otherwise("changed")
    return _unequal(*sides, "key").select("key", change.alias("change"), "first_rows", "second_rows")


def compare(
    spark: SparkSession, first: Sliced, second: Sliced, first_tree: DataFrame, second_tree: DataFrame
) -> DataFrame:
    """``differing_keys`` of two stored builds, of which only slices that differ are read.

    The trees are those of the stored tables, of their key and width.
    """
    if (first.key, first.width) != (second.key, second.width):
        raise ValueError("both builds must be sliced alike")
    slices = [row[0] for row in differing_ranges(first_tree, second_tree).collect()]  # one number per slice
    return differing_keys(first.read(spark, slices), second.read(spark, slices), first.key)
