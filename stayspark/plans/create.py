"""Create rows from typed-in text: parse, validate, number, append."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame

from stayspark.model import table_spec
from stayspark.operators.changes import insert_rows
from stayspark.operators.ids import with_new_keys
from stayspark.operators.ingest import typed_ingest
from stayspark.session import durable


class Created(NamedTuple):
    table: DataFrame
    created: DataFrame
    unparsed: DataFrame
    refused: DataFrame


def create_rows(
    tables: Mapping[str, DataFrame], name: str, raw: DataFrame, order: str
) -> Created:
    """Append text rows to a table as if they were entered one by one, in ``order``.

    The primary key is not part of ``raw``: every row that gets in takes the next free one.
    ``unparsed`` holds the values that are not of their column's type, ``refused`` the rows that
    break a rule.
    """
    spec, table = table_spec(name), tables[name]
    (key,) = spec.primary_key
    kinds = {c: kind for c, kind in spec.kinds.items() if c != key}
    parsed = typed_ingest(raw, kinds, name, order, spec.schema)
    # Provisional keys keep the entry order; refused rows would leave gaps in them.  The batch is
    # stored after each step, because the next one reads it several times.
    numbered = with_new_keys(parsed.clean, table, key, order).select(*table.columns, order)
    applied = insert_rows(table, durable(numbered), spec, order, tables)
    entered = durable(applied.accepted.withColumnRenamed(key, "_provisional"))
    created = with_new_keys(entered, table, key, "_provisional").select(*table.columns)
    return Created(
        table.unionByName(created),
        created,
        parsed.rejects,
        applied.rejected.drop(key),
    )
