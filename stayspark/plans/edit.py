"""Edit stored rows with typed-in text: key and value are parsed, then checked as any change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stayspark.model import TableSpec
from stayspark.operators.changes import update_rows
from stayspark.operators.ingest import typed_ingest
from stayspark.session import durable


class Edited(NamedTuple):
    table: DataFrame
    accepted: DataFrame
    unparsed: DataFrame
    outcomes: DataFrame


def edit_rows(
    table: DataFrame,
    raw: DataFrame,
    spec: TableSpec,
    column: str,
    kind: str,
    order: str,
    parents: Mapping[str, DataFrame] | None = None,
    children: Sequence[tuple[DataFrame, str]] | None = None,
) -> Edited:
    """Set ``column`` as if the edits were entered one by one: ``order``, ``key`` and ``value`` as text.

    ``key`` names a row by its primary key; ``value`` is read as ``kind``: int, str, bool or date.  What
    does not parse is in ``unparsed``, a row per bad text.  ``outcomes`` says of every other edit whether it
    was accepted, superseded by a later one, refused with a reason, or names no row.  A NULL value
    blanks the column where that is allowed.
    """
    (key,) = spec.primary_key
    fields = [StructField("key", table.schema[key].dataType), StructField("value", table.schema[column].dataType)]
    kinds = {"key": "str" if spec.column(key) and dict(table.dtypes)[key] == "string" else "int", "value": kind}
    parsed = typed_ingest(raw.select(order, "key", "value"), kinds, spec.name, order, StructType(fields))
    # The edits are read for their marks and for the results.
    asked = durable(parsed.clean.select(order, F.col("key").alias(key), "value"))
    done = update_rows(table, asked, spec, key, column, order, parents, children)
    return Edited(done.table, done.accepted, parsed.rejects, done.outcomes)
