"""Typed ingest: raw text columns to typed rows, and a report of what did not parse."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayspark.functions.parsing import parse


class Ingested(NamedTuple):
    clean: DataFrame
    rejects: DataFrame


def typed_ingest(
    raw: DataFrame,
    kinds: Mapping[str, str],
    table: str,
    key: str,
    schema: StructType | None = None,
) -> Ingested:
    """Rows whose every column parses go to ``clean``; each bad value is one row of ``rejects``.

    ``kinds`` maps every text column to int, str, bool or date.  ``key`` is a column that
    identifies the raw row; it is carried along untouched.  A NULL is no value, not a bad one.
    With a ``schema`` the values take its types, and one that does not fit is bad.
    """

    def typed(c: str, kind: str) -> Column:
        value = parse(F.col(c), kind)
        return value if schema is None else value.try_cast(schema[c].dataType)

    parsed = raw.select(
        F.col(key),
        *[F.col(c).alias(f"_raw_{c}") for c in kinds],
        *[typed(c, kind).alias(f"_typed_{c}") for c, kind in kinds.items()],
    )
    bad = {c: F.col(f"_raw_{c}").isNotNull() & F.col(f"_typed_{c}").isNull() for c in kinds}
    any_bad = reduce(lambda a, b: a | b, bad.values())
    problems = [
        F.when(
            bad[c],
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_raw_{c}").alias("raw"),
                F.lit(f"expected {kind}").alias("reason"),
            ),
        )
        for c, kind in kinds.items()
    ]
    # A filter on the parsed values would be pushed below the parsing, and every value would be
    # parsed again above it.  Unfolding instead looks at each parsed value once.
    values = F.struct(*[F.col(f"_typed_{c}").alias(c) for c in kinds])
    clean = (
        parsed.select(key, F.explode_outer(F.when(~any_bad, F.array(values))).alias("row"))
        .where(F.col("row").isNotNull())
        .select(key, "row.*")
    )
    rejects = (
        parsed.select(key, F.explode(F.array(*problems)).alias("problem"))
        .where(F.col("problem").isNotNull())
        .select(F.lit(table).alias("table_name"), key, "problem.*")
    )
    return Ingested(clean, rejects)
