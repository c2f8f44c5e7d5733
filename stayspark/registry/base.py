"""Registration, and how the given tables play the booking roles.

nation = hotel, customer = who books and through whom a booking reaches its hotel, orders =
booking and invoice, lineitem = room, supplier = review.  Money is summed in cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import minor_units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as bookings; an open order has no cancellation flag yet."""
    return read(spark, folder, "orders").selectExpr(
        "o_orderkey AS BookingID",
        "o_custkey AS CustomerCustomerID",
        "CAST(o_orderdate AS DATE) AS Arrival_date",
        "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS Cancellation",
    )


def rooms(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as rooms.  Line numbers repeat, so the room number is the whole line.

    It is one number, which orders as the columns do and stays in hash aggregation: 3 digits of line
    number, 11 each of part and supplier, 13 of cents.
    """
    priced = read(spark, folder, "lineitem").withColumn(
        "Price", minor_units(F.col("l_extendedprice"))
    )
    parts = [("l_linenumber", 3), ("l_partkey", 11), ("l_suppkey", 11), ("Price", 13)]
    digits = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in parts]
    number = F.concat(*digits).cast("decimal(38,0)")
    return priced.select(
        F.col("l_orderkey").alias("BookingBookingID"), "Price", number.alias("Room_number")
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    priced = read(spark, folder, "orders").withColumn("Amount", minor_units(F.col("o_totalprice")))
    return priced.selectExpr("o_orderkey AS InvoiceID", "o_orderkey AS BookingBookingID", "Amount")


def stays(spark: SparkSession, folder: str) -> DataFrame:
    """Bookings with a checkout: one to fourteen nights, by customer."""
    nights = (1 + F.col("CustomerCustomerID") % 14).cast("int")
    return bookings(spark, folder).withColumn("Checkout_date", F.date_add("Arrival_date", nights))


# SQL fragments.  Money in SQL is DECIMAL, which checks the cent arithmetic independently.
LINE_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


def sql_percent(part: str, whole: str) -> str:
    share = f"100e0 * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)"
    return f"CAST(round_even(CAST({share} AS DECIMAL(18,6)), 1) AS DECIMAL(18,1))"


def sql_money(value: str) -> str:
    return f"CAST({value} AS DECIMAL(28,2))"
