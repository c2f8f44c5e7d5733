"""Running sums and maxima inside groups of any size.

A window over a group sorts it in one task.  Here the rows are dealt out by ranges of group and order, so a
hot group lies over many tasks; each task adds up its own stretch, and the totals of the stretches
before it, one small row per task and group, are joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayspark.session import durable


def _joined(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
    return F.greatest(before, inside)  # of one null the other


def running(
    rows: DataFrame,
    group: list[str],
    order: list[Column | str],
    values: dict[str, tuple[str, Column]],
    small: bool = False,
) -> DataFrame:
    """``rows`` with one more column per entry of ``values``: what the rows before it in its group add up to.

    ``values`` gives a kind, ``sum`` or ``max``, and a column, of which nulls do not count.  Before the first row of a group a
    sum is 0 and a maximum null.  Rows stand in the order of ``order``; equal ones
    stand in any order, but the same one for all values.  A null is a group of its own.

    ``small`` says that every group has been counted and fits into a task: a plain window does then.
    """
    names = list(values)
    if small:
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = {n: getattr(F, kind)(c).over(before) for n, (kind, c) in values.items()}
        return rows.withColumns({n: F.coalesce(s, F.lit(0)) if values[n][0] == "sum" else s for n, s in sums.items()})
    inputs = {f"_in_{n}": c for n, (_, c) in values.items()}
    placed = rows.withColumns(inputs).repartitionByRange(*group, *order)
    # Stored, so that a repeated task finds every row in the stretch it was in before.
    placed = durable(placed.withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*group, "_part").agg(
        *[getattr(F, values[n][0])(f"_in_{n}").alias(f"_own_{n}") for n in names]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(g).alias(f"_of_{g}") for g in group],
        F.col("_part").alias("_of_part"),
        *[getattr(F, values[n][0])(f"_own_{n}").over(earlier).alias(f"_before_{n}") for n in names],
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_in_{n}": getattr(F, values[n][0])(f"_in_{n}").over(inside) for n in names})
    same = local["_part"] == parts["_of_part"]
    for g in group:
        same = same & local[g].eqNullSafe(parts[f"_of_{g}"])
    return local.join(parts, same).select(
        *[local[c] for c in rows.columns],
        *[
            _joined(values[n][0], F.col(f"_before_{n}"), F.col(f"_in_{n}")).alias(n)
            for n in names
        ],
    )
