"""Nights, invoice amounts and the audits around them.

Rooms are folded to one row per booking *before* any join, so a booking with many rooms cannot
multiply anything, and every join is one row to at most one row on the booking key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_nights(bookings: DataFrame) -> DataFrame:
    """``Duration`` = days from arrival to checkout."""
    return bookings.withColumn("Duration", F.datediff("Checkout_date", "Arrival_date"))


def room_totals(rooms: DataFrame) -> DataFrame:
    """Per booking: rooms, nightly total, cheapest price and the price of the first room."""
    return (
        rooms.where(F.col("BookingBookingID").isNotNull())
        .groupBy(F.col("BookingBookingID").alias("BookingID"))
        .agg(
            F.expr("count(Room_number) AS rooms"),
            F.expr("sum(Price) AS nightly_total"),
            F.expr("min(Price) AS cheapest_price"),
            F.expr("min_by(Price, Room_number) AS first_price"),
        )
    )


def booking_amounts(bookings: DataFrame, rooms: DataFrame) -> DataFrame:
    """(BookingID, amount): nights times the nightly price of every room, 0 without a room."""
    totals = room_totals(rooms).select("BookingID", "nightly_total")
    amount = F.coalesce(F.col("Duration") * F.col("nightly_total"), F.lit(0).cast("bigint"))
    return (
        bookings.select("BookingID", "Duration")
        .join(totals, "BookingID", "left")
        .select("BookingID", amount.alias("amount"))
    )


def _billed(invoices: DataFrame, bookings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Invoices beside the amount their booking comes to; 0 for an unknown booking."""
    amounts = booking_amounts(bookings, rooms).select(
        F.col("BookingID").alias("BookingBookingID"), F.col("amount").alias("_derived")
    )
    return invoices.join(amounts, "BookingBookingID", "left").withColumn(
        "_derived", F.coalesce("_derived", F.lit(0).cast("bigint"))
    )


def with_amounts(invoices: DataFrame, bookings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Invoices with ``Amount`` recomputed; running it again changes nothing."""
    billed = _billed(invoices, bookings, rooms)
    return billed.withColumn("Amount", F.col("_derived")).select(*invoices.columns)


def amount_mismatches(invoices: DataFrame, bookings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Invoices whose stored amount is not the derived one, NULLs included."""
    billed = _billed(invoices.select("InvoiceID", "BookingBookingID", "Amount"), bookings, rooms)
    return billed.where(~F.col("Amount").eqNullSafe(F.col("_derived"))).select(
        "InvoiceID",
        "BookingBookingID",
        F.col("Amount").alias("stored_amount"),
        F.col("_derived").alias("derived_amount"),
    )


def multi_room_invoices(
    invoices: DataFrame, bookings: DataFrame, rooms: DataFrame
) -> DataFrame:
    """Invoices over several rooms, beside what billing only the cheapest room would give."""
    several = room_totals(rooms).where("rooms > 1")
    return (
        invoices.select("InvoiceID", F.col("BookingBookingID").alias("BookingID"), "Amount")
        .join(bookings.select("BookingID", F.col("Duration").alias("nights")), "BookingID")
        .join(several, "BookingID")
        .select(
            "InvoiceID",
            "BookingID",
            "nights",
            "rooms",
            "nightly_total",
            "Amount",
            (F.col("nights") * F.col("cheapest_price")).alias("if_only_one_room_were_billed"),
        )
    )


def largest(frame: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows with the greatest ``by``; ties go to the smaller key."""
    return frame.orderBy(F.desc(by), F.asc(key)).limit(k)


def underbilling(invoices: DataFrame, bookings: DataFrame, rooms: DataFrame) -> DataFrame:
    """One row: the total over all rooms, the total if only the first room counted, the gap."""
    zero = F.lit(0).cast("bigint")
    per_invoice = (
        invoices.select(F.col("BookingBookingID").alias("BookingID"))
        .join(bookings.select("BookingID", "Duration"), "BookingID", "left")
        .join(room_totals(rooms), "BookingID", "left")
        .select(
            F.coalesce(F.col("Duration") * F.col("nightly_total"), zero).alias("correct"),
            F.coalesce(F.col("Duration") * F.col("first_price"), zero).alias("naive"),
            F.coalesce(F.col("rooms"), zero).alias("rooms"),
        )
    )
    return per_invoice.agg(
        F.count(F.lit(1)).alias("invoices"),
        F.count_if(F.col("rooms") > 1).alias("multi_room_invoices"),
        F.count_if(F.col("correct") != F.col("naive")).alias("affected_invoices"),
        F.sum("correct").alias("correct_total"),
        F.sum("naive").alias("naive_total"),
        F.sum(F.col("correct") - F.col("naive")).alias("underbilled"),
    )
