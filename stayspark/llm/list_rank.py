"""Prefix sums along linked lists that lie over a whole cluster.

Every element knows the one before it.  Pointers are doubled, but only as far as the next ruler, one element in ``EVERY`` by
a hash; the gaps between rulers are short, so that takes few rounds however long the list is.
The rulers make up a list a fraction as long, which is ranked likewise, down to a list of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayspark.session import durable, in_rounds

EVERY = 128
# Elements of a list that one task ranks by itself.
ONE_TASK = 512


def _walked(sums: list[str]):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        after = {None if r["pred"] is None else tuple(r["pred"].values()): r for r in rows if r["pred"]}
        done = []
        for row in rows:
            if row["pred"] is None:
                held = [0] * len(sums)
                while row is not None:
                    held = [h + row[s] for h, s in zip(held, sums, strict=True)]
                    done.append({"id": row["id"], **dict(zip(sums, held, strict=True))})
                    row = after.get(tuple(row["id"].values()))
        schema = pa.schema([table.schema.field("id"), *[pa.field(s, pa.int64()) for s in sums]])
        return pa.Table.from_pylist(done, schema)

    return run


def _doubled(state: DataFrame, sums: list[str], store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state`` with every pointer moved on until it is ``there``, and the sums of what it has passed."""
    moving = True
    while moving:
        next_ = state.select(
            F.col("id").alias("_id"), F.col("pred").alias("_pred"), F.col("there").alias("_there"),
            *[F.col(s).alias(f"_{s}") for s in sums],
        )
        # Elements that are there meet theirs as well and keep what they have: no union, whose parts would add up.
        step = ~F.col("there")
        met = state.join(next_, F.col("pred") == F.col("_id"), "left")
        state = store(
            met.select(
                "id", F.when(step, F.col("_pred")).otherwise(F.col("pred")).alias("pred"),
                *[(F.col(s) + F.when(step, F.col(f"_{s}")).otherwise(0)).alias(s) for s in sums],
                F.when(step, F.col("_there")).otherwise(F.lit(True)).alias("there"),
            )
        )
        moving = not state.where("NOT there").isEmpty()
    return state


def prefix_sums(elements: DataFrame, sums: list[str], salt: int = 0) -> DataFrame:
    """``id`` and, for every column of ``sums``, its sum from the first element of the list up to this one.

    ``elements`` have ``id`` and ``pred``, structs of the same whole numbers; ``pred`` is null where a list starts, else
    the id of exactly one other element, and ids are unique.  There may be several lists.
    """
    elements = durable(elements.select("id", "pred", *[F.col(s).cast("long").alias(s) for s in sums]))
    if elements.count() <= ONE_TASK:
        schema = T.StructType([elements.schema["id"], *[T.StructField(s, T.LongType()) for s in sums]])
        return durable(elements.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_walked(sums), schema))

    def ruler(element: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), element), F.lit(EVERY)) == 0

    def reached(pointer: Column) -> Column:
        return pointer.isNull() | ruler(pointer)

    state = elements.withColumn("there", reached(F.col("pred")))
    with in_rounds(elements.sparkSession) as store:
        state = durable(_doubled(state, sums, store))
    rulers = prefix_sums(state.where(ruler(F.col("id"))), sums, salt + 1)
    known = rulers.select(F.col("id").alias("_id"), *[F.col(s).alias(f"_{s}") for s in sums])
    others = state.where(~ruler(F.col("id"))).join(known, F.col("pred") == F.col("_id"), "left")
    found = others.select("id", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
    return durable(rulers.unionByName(found))
