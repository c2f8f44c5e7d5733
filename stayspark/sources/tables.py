"""The six tables as DataFrames, Parquet folders, or bucketed catalog tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.model import TABLES, table_spec
from stayspark.sources import generator
from stayspark.sources.sample import sample_table

# The column every large table is joined on; bucketing on it lets billing and revenue jobs read
# co-located buckets instead of shuffling.
BOOKING_KEY = {
    "Booking": "BookingID",
    "Room": "BookingBookingID",
    "Invoice": "BookingBookingID",
    "Feedback": "BookingBookingID",
}

# Files that one bucket is written to, each by a task of its own.
FILES_PER_BUCKET = 4


def all_tables(
    spark: SparkSession,
    size: int = generator.DEFAULT_SIZE,
    second_room_base: int = generator.SECOND_ROOM_BASE,
    customer_count: int = generator.DEFAULT_SIZE + generator.HAND_CUSTOMERS,
) -> dict[str, DataFrame]:
    """Sample rows plus ``size`` generated rows; nights and amounts are not derived yet.

    The defaults are those of the published data set.  The first primary room numbers have room for
    ``second_room_base`` less ``ROOM_BASE`` bookings; a larger build must name a base beyond them.
    Customers are drawn from ``customer_count``, all of whom must be built.
    """
    if generator.ROOM_BASE + size > second_room_base:
        raise ValueError(f"{size} primary rooms overlap second rooms from {second_room_base} on")
    if customer_count > size + generator.HAND_CUSTOMERS:
        raise ValueError(f"{size} rows do not give {customer_count} customers")
    rows = generator.with_hashes(generator.row_numbers(spark, size))
    tables = {name: sample_table(spark, name) for name in TABLES}
    generated = {
        "Customer": [generator.customers(rows)],
        "Booking": [generator.bookings(rows, customer_count)],
        "Room": [
            generator.primary_rooms(rows),
            generator.second_rooms(rows, second_room_base),
        ],
        "Invoice": [generator.invoices(rows)],
        "Feedback": [generator.feedback(rows)],
    }
    for name, parts in generated.items():
        for part in parts:
            tables[name] = tables[name].unionByName(part)
    return tables


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(table_spec(name).schema).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in TABLES}


def save_bucketed(
    tables: Mapping[str, DataFrame], buckets: int, prefix: str = "", folder: str | None = None
) -> None:
    """Save the tables to the catalog, the large ones bucketed on the booking key."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format("parquet")
        if folder is not None:
            writer = writer.option("path", f"{folder}/{name}")
        if name in BOOKING_KEY:
            key = BOOKING_KEY[name]
            # A bucket is at most FILES_PER_BUCKET sorted files, and so is a hot or missing key.
            part = F.pmod(F.xxhash64(*table.columns), F.lit(FILES_PER_BUCKET))
            writer = (
                table.repartition(buckets * FILES_PER_BUCKET, F.hash(key) % buckets, part)
                .write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
            )
            if folder is not None:
                writer = writer.option("path", f"{folder}/{name}")
        writer.saveAsTable(f"{prefix}{name}")
