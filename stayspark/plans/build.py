"""Build the six tables, derive nights and amounts, and recompute them for stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from stayspark.operators.billing import with_amounts, with_nights
from stayspark.sources.generator import DEFAULT_SIZE
from stayspark.sources.tables import all_tables, read_tables, write_tables


def derived(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with ``Booking.Duration`` and ``Invoice.Amount`` recomputed from the rest."""
    bookings = with_nights(tables["Booking"])
    return {
        **tables,
        "Booking": bookings,
        "Invoice": with_amounts(tables["Invoice"], bookings, tables["Room"]),
    }


def build(
    spark: SparkSession, folder: str, size: int = DEFAULT_SIZE, **bounds: int
) -> dict[str, DataFrame]:
    """Write the six tables to ``folder``, replacing what is there, and return them.

    ``bounds`` are those of ``all_tables``.
    """
    write_tables(derived(all_tables(spark, size, **bounds)), folder)
    return read_tables(spark, folder)


def recompute(spark: SparkSession, source: str, target: str) -> dict[str, DataFrame]:
    """Re-derive stored tables into a new folder."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target must differ from the source")
    write_tables(derived(read_tables(spark, source)), target)
    return read_tables(spark, target)
