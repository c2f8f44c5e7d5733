"""Nights, invoice amounts and billing audits over orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import money
from stayspark.operators import billing
from stayspark.registry.base import (
    LINE_PRICE,
    bookings,
    invoices,
    query,
    rooms,
    sql_money,
    stays,
)

_STAYS = f"""
WITH lines AS (
  SELECT l_orderkey, count(*) AS rooms, sum({LINE_PRICE}) AS nightly_total,
         min({LINE_PRICE}) AS cheapest,
         arg_min({LINE_PRICE}, ROW(l_linenumber, l_partkey, l_suppkey, {LINE_PRICE})) AS first_price
  FROM lineitem GROUP BY l_orderkey),
stays AS (
  SELECT *, CAST(o_orderdate AS DATE) + CAST(1 + o_custkey % 14 AS INTEGER) AS checkout,
         1 + o_custkey % 14 AS nights, CAST(o_totalprice AS DECIMAL(18,2)) AS stored
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)
"""


def _nights(spark: SparkSession, folder: str) -> DataFrame:
    return billing.with_nights(stays(spark, folder))


def _one_night(spark: SparkSession, folder: str) -> DataFrame:
    return bookings(spark, folder).withColumn("Duration", F.lit(1))


@query(
    _STAYS
    + """SELECT o_orderkey AS BookingID, CAST(o_orderdate AS DATE) AS Arrival_date,
  checkout AS Checkout_date, CAST(nights AS INTEGER) AS Duration FROM stays"""
)
def order_durations(spark: SparkSession, folder: str) -> DataFrame:
    return _nights(spark, folder).select("BookingID", "Arrival_date", "Checkout_date", "Duration")


@query(
    _STAYS
    + f"""SELECT o_orderkey AS BookingID, {sql_money("coalesce(nights * nightly_total, 0)")} AS amount
FROM stays"""
)
def stay_invoice_amounts(spark: SparkSession, folder: str) -> DataFrame:
    amounts = billing.booking_amounts(_nights(spark, folder), rooms(spark, folder))
    return amounts.withColumn("amount", money(F.col("amount")))


@query(
    _STAYS
    + f"""SELECT o_orderkey AS InvoiceID, o_orderkey AS BookingBookingID,
  {sql_money("coalesce(nightly_total, 0)")} AS Amount FROM stays"""
)
def invoice_amounts(spark: SparkSession, folder: str) -> DataFrame:
    filled = billing.with_amounts(
        invoices(spark, folder), _one_night(spark, folder), rooms(spark, folder)
    )
    return filled.withColumn("Amount", money(F.col("Amount")))


@query(
    _STAYS
    + f"""SELECT o_orderkey AS InvoiceID, o_orderkey AS BookingBookingID,
  {sql_money("stored")} AS stored_amount,
  {sql_money("coalesce(nightly_total, 0)")} AS derived_amount FROM stays
WHERE stored IS DISTINCT FROM coalesce(nightly_total, 0)"""
)
def invoice_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    found = billing.amount_mismatches(
        invoices(spark, folder), _one_night(spark, folder), rooms(spark, folder)
    )
    return found.withColumns(
        {c: money(F.col(c)) for c in ("stored_amount", "derived_amount")}
    )


@query(
    _STAYS
    + f"""SELECT o_orderkey AS InvoiceID, o_orderkey AS BookingID, CAST(nights AS INTEGER) AS nights,
  rooms, {sql_money("nightly_total")} AS nightly_total,
  {sql_money("stored")} AS Amount,
  {sql_money("nights * cheapest")} AS if_only_one_room_were_billed
FROM stays WHERE rooms > 1 ORDER BY stored DESC, o_orderkey LIMIT 5"""
)
def multi_line_invoices_top5(spark: SparkSession, folder: str) -> DataFrame:
    several = billing.multi_room_invoices(
        invoices(spark, folder), _nights(spark, folder), rooms(spark, folder)
    )
    top = billing.largest(several, "Amount", "InvoiceID", 5)
    return top.withColumns(
        {
            c: money(F.col(c))
            for c in ("nightly_total", "Amount", "if_only_one_room_were_billed")
        }
    )


@query(
    _STAYS
    + f"""SELECT count(*) AS invoices, count(*) FILTER (rooms > 1) AS multi_room_invoices,
  count(*) FILTER (coalesce(nightly_total, 0) <> coalesce(first_price, 0)) AS affected_invoices,
  {sql_money("sum(coalesce(nightly_total, 0))")} AS correct_total,
  {sql_money("sum(coalesce(first_price, 0))")} AS naive_total,
  {sql_money("sum(coalesce(nightly_total, 0) - coalesce(first_price, 0))")} AS underbilled
FROM stays"""
)
def underbilling_audit(spark: SparkSession, folder: str) -> DataFrame:
    audit = billing.underbilling(
        invoices(spark, folder), _one_night(spark, folder), rooms(spark, folder)
    )
    return audit.withColumns(
        {c: money(F.col(c)) for c in ("correct_total", "naive_total", "underbilled")}
    )
