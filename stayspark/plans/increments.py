"""Nights, amounts and risk figures for what changed only.

Bookings, rooms and invoices are stored in slices of booking keys.  A delta of bookings and rooms is carried to
the invoices it touches; slices without a change are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.operators.billing import with_amounts, with_nights
from stayspark.operators.deltas import CHANGE, applied
from stayspark.operators.unions import union_all
from stayspark.session import durable
from stayspark.sources.slices import Sliced, slice_numbers
from stayspark.sources.tables import BOOKING_KEY

# What a row of each table is known by.
ROW_KEY = {"Booking": "BookingID", "Room": "Room_number", "Invoice": "InvoiceID"}


def store(tables: Mapping[str, DataFrame], folder: str, width: int) -> dict[str, Sliced]:
    """Store the tables in slices of ``width`` booking keys, with nights and amounts as they are."""
    stored = {}
    for name in ROW_KEY:
        stored[name] = Sliced(f"{folder}/{name}", BOOKING_KEY[name], width, tables[name].schema)
        stored[name].write(tables[name])
    return stored


def _changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The delta between two states with one row per key on either side."""
    columns = [c for c in before.columns if c != key]
    whole = F.struct(*columns)
    old, new = before.select(key, whole.alias("old")), after.select(key, whole.alias("new"))
    pairs = old.join(new, key, "full_outer").where("NOT (old <=> new)")
    sides = F.array(
        F.struct(F.col("old").alias("row"), F.lit(-1).alias(CHANGE)),
        F.struct(F.col("new").alias("row"), F.lit(1).alias(CHANGE)),
    )
    return pairs.select(key, F.inline(sides)).where("row IS NOT NULL").select(
        *[F.col(key) if c == key else F.col(f"row.{c}") for c in before.columns], CHANGE
    )


def recompute_touched(
    spark: SparkSession, stored: Mapping[str, Sliced], deltas: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Apply deltas of ``Booking``, ``Room`` and ``Invoice`` and bill the bookings they touch anew.

    Nights and amounts within the deltas are ignored and derived.  Returns the deltas of all three tables with
    what followed from them; the result is that of a full recompute, provided that the stored rows were derived
    before.  Deltas are as large as the change, and so is what is shuffled.  Run again with the same deltas,
    for one after a failure, it leaves the same tables.
    """
    given = {name: durable(deltas[name]) for name in ROW_KEY if name in deltas}
    if not given:
        return {}
    keys = [delta.select(F.col(BOOKING_KEY[name]).alias("key")) for name, delta in given.items()]
    touched = durable(union_all(keys).distinct())
    slices = slice_numbers(touched, stored["Booking"].width)

    before = {name: stored[name].read(spark, slices) for name in ROW_KEY}
    after = {
        name: applied(rows, given[name], ROW_KEY[name]) if name in given else rows for name, rows in before.items()
    }

    def among(name: str, rows: DataFrame) -> DataFrame:
        return rows.join(touched.withColumnRenamed("key", BOOKING_KEY[name]), BOOKING_KEY[name], "left_semi")

    def with_missing_keys(name: str, rows: DataFrame) -> DataFrame:
        """A join on the key leaves out rows without one, which only a delta of their own touches."""
        if name not in given:
            return among(name, rows)
        missing = rows.where(F.col(BOOKING_KEY[name]).isNull())
        moved = given[name].select(ROW_KEY[name]).distinct()
        return among(name, rows).unionByName(missing.join(moved, ROW_KEY[name], "left_semi"))

    bookings = with_nights(among("Booking", after["Booking"]))
    invoices = with_amounts(with_missing_keys("Invoice", after["Invoice"]), bookings, among("Room", after["Room"]))
    changes = {
        "Booking": _changed(among("Booking", before["Booking"]), bookings, ROW_KEY["Booking"]),
        "Invoice": _changed(with_missing_keys("Invoice", before["Invoice"]), invoices, ROW_KEY["Invoice"]),
    }
    if "Room" in given:
        changes["Room"] = given["Room"]
    changes = {name: durable(delta) for name, delta in changes.items()}
    for name, delta in changes.items():
        rewritten = slice_numbers(delta.select(BOOKING_KEY[name]), stored[name].width)
        if rewritten:
            rows = applied(stored[name].read(spark, rewritten), delta, ROW_KEY[name])
            stored[name].replace(durable(rows), rewritten)
    return changes
