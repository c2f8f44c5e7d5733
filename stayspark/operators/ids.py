"""New primary keys: one past the greatest, for a single row or for a whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS = 16


def next_key(table: DataFrame, key: str) -> DataFrame:
    """One row: the greatest key + 1, or 1 for an empty table."""
    return table.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("bigint").alias("next_key"))


def with_positions(rows: DataFrame, order: str, into: str) -> DataFrame:
    """The 1-based position of every row by a unique BIGINT column.

    A plain ``row_number`` over everything would sort the whole batch in one task.  Here the
    order value is read as 16-bit digits: every window below sees one digit of one prefix, so no
    task ever holds more than 65,536 entries of a group, whatever the number of rows.
    """
    fine, mid, top = (F.shiftright(F.col(order), _BITS * d) for d in (1, 2, 3))
    rows = rows.withColumn("_b1", fine)
    # shiftright keeps the sign, so prefixes sort like the values they come from.
    per_fine = rows.groupBy("_b1", mid.alias("_b2"), top.alias("_b3")).agg(
        F.count(F.lit(1)).alias("_n1")
    )
    per_mid = per_fine.groupBy("_b2", "_b3").agg(F.sum("_n1").alias("_n2"))
    per_top = per_mid.groupBy("_b3").agg(F.sum("_n2").alias("_n3"))

    def before(count: str, window: Window):
        rows_before = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(count).over(rows_before), F.lit(0))

    # At most 65,536 rows: the top digit of a 64-bit value.
    per_top = per_top.select("_b3", before("_n3", Window.orderBy("_b3")).alias("_o3"))
    per_mid = per_mid.select(
        "_b2", "_b3", before("_n2", Window.partitionBy("_b3").orderBy("_b2")).alias("_o2")
    )
    per_fine = per_fine.select(
        "_b1", "_b2", before("_n1", Window.partitionBy("_b2").orderBy("_b1")).alias("_o1")
    )
    offsets = (
        per_fine.join(per_mid, "_b2")
        .join(per_top, "_b3")
        .select("_b1", (F.col("_o1") + F.col("_o2") + F.col("_o3")).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("_b1").orderBy(order))
    return (
        rows.withColumn("_local", local)
        .join(offsets, "_b1")
        .withColumn(into, F.col("_offset") + F.col("_local"))
        .drop("_b1", "_local", "_offset")
    )


def with_new_keys(rows: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """Give a batch the keys that inserting its rows one by one, in ``order``, would give."""
    first = next_key(table, key).scalar()
    return with_positions(rows, order, "_position").withColumn(
        key, first + F.col("_position") - 1
    ).drop("_position")
