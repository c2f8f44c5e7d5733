"""Joins that stay balanced when one key holds a large part of the rows.

Aggregations need no help: partial aggregation folds a hot key inside every map task.  A join that
must return *rows* of a hot key is left to adaptive execution, which reads the sizes of the shuffled
partitions and cuts the large ones; that holds for inner, left, semi and anti joins with one row
per key on the right, the only ones used here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def keys_among(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """The distinct keys that are also in ``wanted``, a frame of distinct keys.

    Where ``wanted`` is small enough to broadcast, Catalyst filters the keys before it folds them
    and a large table is only scanned; otherwise hot keys are folded before the shuffle.
    """
    return keys.distinct().join(wanted, wanted.columns, "left_semi")
