"""Revenue at risk per nation, and the summaries drawn from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import minor_units, money
from stayspark.operators.billing import room_totals
from stayspark.plans import revenue
from stayspark.registry.base import (
    LINE_PRICE,
    bookings,
    invoices,
    query,
    read,
    rooms,
    sql_money,
    sql_percent,
)
from stayspark.session import durable


def _facts(spark: SparkSession, folder: str, three_valued: bool = False) -> DataFrame:
    """One row per order: customer, cancelled, amount in cents (0 without a line item)."""
    totals = room_totals(rooms(spark, folder)).select("BookingID", "nightly_total")
    flag = "Cancellation" if three_valued else "coalesce(Cancellation, 0)"
    return (
        bookings(spark, folder)
        .join(totals, "BookingID", "left")
        .selectExpr(
            "CustomerCustomerID AS c_custkey",
            f"{flag} AS cancelled",
            "coalesce(nightly_total, 0) AS amount",
        )
    )


def _per_nation(spark: SparkSession, folder: str, three_valued: bool = False) -> DataFrame:
    """Folded per customer first: the join to customers then has unique keys on both sides."""
    owners = read(spark, folder, "customer").selectExpr("c_custkey", "c_nationkey AS hotel_id")
    per_customer = revenue.measures(_facts(spark, folder, three_valued), "c_custkey")
    return revenue.roll_up(per_customer, owners, "c_custkey", "hotel_id")


def _risk(spark: SparkSession, folder: str) -> DataFrame:
    hotels = read(spark, folder, "nation").selectExpr("n_nationkey AS hotel_id", "n_name AS hotel")
    feedback = read(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("HotelHotelID"),
        minor_units(F.col("s_acctbal")).alias("Rating"),
    )
    return revenue.risk_table(
        hotels, _per_nation(spark, folder), revenue.ratings(feedback, unit=100)
    )


def _in_money(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: money(F.col(c)) for c in columns})


_BASE = f"""
WITH amounts AS (
  SELECT l_orderkey, sum({LINE_PRICE}) AS amount FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey, c_nationkey AS hotel_id, coalesce(amount, 0) AS amount,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS cancelled,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS flag
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN amounts ON l_orderkey = o_orderkey),
per_hotel AS (
  SELECT hotel_id, count(*) AS bookings, CAST(sum(cancelled) AS BIGINT) AS cancelled,
         sum(amount) AS booked_revenue,
         sum(CASE WHEN cancelled = 1 THEN amount ELSE 0 END) AS lost_revenue,
         sum(CASE WHEN cancelled = 0 THEN amount ELSE 0 END) AS realised_revenue
  FROM facts GROUP BY hotel_id),
rated AS (
  SELECT s_nationkey, count(*) AS reviews,
         round(CAST(avg(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,6)), 2) AS avg_rating
  FROM supplier GROUP BY s_nationkey),
risk AS (
  SELECT n_nationkey AS hotel_id, n_name AS hotel, bookings, cancelled, booked_revenue,
         lost_revenue, realised_revenue, avg_rating, coalesce(reviews, 0) AS reviews,
         {sql_percent("cancelled", "bookings")} AS cancel_rate_pct,
         {sql_percent("lost_revenue", "booked_revenue")} AS lost_share_pct
  FROM nation JOIN per_hotel ON hotel_id = n_nationkey LEFT JOIN rated ON s_nationkey = n_nationkey)
"""


@query(
    _BASE
    + f"""SELECT hotel_id, hotel, bookings, cancelled,
  {sql_money("booked_revenue")} AS booked_revenue, {sql_money("lost_revenue")} AS lost_revenue,
  {sql_money("realised_revenue")} AS realised_revenue,
  CAST(avg_rating AS DECIMAL(18,2)) AS avg_rating, reviews, cancel_rate_pct, lost_share_pct
FROM risk ORDER BY lost_revenue DESC, hotel_id"""
)
def revenue_at_risk(spark: SparkSession, folder: str) -> DataFrame:
    frame = revenue.worst_first(_risk(spark, folder))
    return _in_money(frame, "booked_revenue", "lost_revenue", "realised_revenue")


@query(
    _BASE
    + f"""SELECT hotel_id, hotel, {sql_money("lost_revenue")} AS lost_revenue
FROM risk ORDER BY lost_revenue, hotel_id"""
)
def loss_chart_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _in_money(revenue.smallest_loss_first(_risk(spark, folder)), "lost_revenue")


@query(
    _BASE
    + f"""SELECT count(*) AS hotels, CAST(sum(bookings) AS BIGINT) AS bookings,
  {sql_money("sum(booked_revenue)")} AS booked_revenue,
  {sql_money("sum(lost_revenue)")} AS lost_revenue,
  {sql_percent("sum(lost_revenue)", "sum(booked_revenue)")} AS lost_pct
FROM risk"""
)
def portfolio_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _in_money(
        revenue.portfolio_totals(_risk(spark, folder)), "booked_revenue", "lost_revenue"
    )


@query(
    _BASE
    + f""", top AS (SELECT * FROM risk ORDER BY lost_revenue DESC, hotel_id LIMIT 3)
SELECT count(*) AS hotels, {sql_money("sum(lost_revenue)")} AS top_lost_revenue,
  CAST(sum(bookings) AS BIGINT) AS top_bookings,
  {sql_percent("sum(lost_revenue)", "(SELECT sum(lost_revenue) FROM risk)")} AS share_of_loss_pct,
  {sql_percent("sum(bookings)", "(SELECT sum(bookings) FROM risk)")} AS share_of_bookings_pct
FROM top"""
)
def loss_concentration_top3(spark: SparkSession, folder: str) -> DataFrame:
    # One row per hotel, read twice below: stored so that the line items are scanned once.
    frame = durable(_risk(spark, folder).select("hotel_id", "bookings", "lost_revenue"))
    return _in_money(revenue.loss_concentration(frame, 3), "top_lost_revenue")


@query(
    _BASE
    + """SELECT count(*) AS hotels, CAST(round(CAST(
  covar_pop(CAST(avg_rating AS DOUBLE), CAST(cancel_rate_pct AS DOUBLE))
  / nullif(stddev_pop(CASE WHEN cancel_rate_pct IS NOT NULL THEN CAST(avg_rating AS DOUBLE) END)
         * stddev_pop(CASE WHEN avg_rating IS NOT NULL THEN CAST(cancel_rate_pct AS DOUBLE) END), 0)
  AS DECIMAL(18,9)), 6) AS DECIMAL(18,6)) AS r
FROM risk"""
)
def rating_vs_cancel_corr(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.rating_correlation(_risk(spark, folder))


@query(
    _BASE
    + f""", rate AS (SELECT * FROM risk ORDER BY cancel_rate_pct DESC, hotel_id LIMIT 1),
mon AS (SELECT * FROM risk ORDER BY lost_revenue DESC, hotel_id LIMIT 1)
SELECT rate.hotel AS worst_by_rate, rate.cancel_rate_pct AS worst_rate_pct,
  {sql_money("rate.lost_revenue")} AS worst_rate_lost, mon.hotel AS worst_by_money,
  mon.cancel_rate_pct AS worst_money_pct, {sql_money("mon.lost_revenue")} AS worst_money_lost,
  rate.hotel_id = mon.hotel_id AS same_hotel
FROM rate, mon"""
)
def rank_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    return _in_money(
        revenue.rank_disagreement(_risk(spark, folder)), "worst_rate_lost", "worst_money_lost"
    )


@query(
    _BASE
    + f""", split AS (
  SELECT hotel_id, sum(amount) AS booked,
         sum(CASE WHEN flag = 1 THEN amount ELSE 0 END) AS lost,
         sum(CASE WHEN flag = 0 THEN amount ELSE 0 END) AS realised
  FROM facts GROUP BY hotel_id)
SELECT hotel_id, {sql_money("booked")} AS booked_revenue, {sql_money("lost")} AS lost_revenue,
  {sql_money("realised")} AS realised_revenue, {sql_money("booked - lost - realised")} AS unexplained
FROM split WHERE booked <> lost + realised"""
)
def revenue_identity_violations(spark: SparkSession, folder: str) -> DataFrame:
    frame = revenue.identity_violations(_per_nation(spark, folder, three_valued=True))
    return _in_money(
        frame, "booked_revenue", "lost_revenue", "realised_revenue", "unexplained"
    )


@query(
    _BASE
    + f""", report AS (
  SELECT sum(booked_revenue) AS booked, sum(lost_revenue) AS lost FROM risk),
direct AS (
  SELECT (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS booked,
         (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders WHERE o_orderstatus = 'F')
           AS lost)
SELECT {sql_money("r.booked")} AS report_booked, {sql_money("r.lost")} AS report_lost,
  {sql_money("d.booked")} AS invoice_booked, {sql_money("d.lost")} AS invoice_lost,
  {sql_money("r.booked - d.booked")} AS booked_difference,
  {sql_money("r.lost - d.lost")} AS lost_difference
FROM report r, direct d"""
)
def reconcile_totals(spark: SparkSession, folder: str) -> DataFrame:
    frame = revenue.reconcile(
        _risk(spark, folder), bookings(spark, folder), invoices(spark, folder)
    )
    return _in_money(frame, *frame.columns)


@query(
    """SELECT 'orders per customer' AS what, count(*) AS hotels, min(n) AS min_rows,
  max(n) AS max_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
UNION ALL
SELECT 'suppliers per nation', count(*), min(n), max(n)
FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)"""
)
def bookings_per_hotel_minmax(spark: SparkSession, folder: str) -> DataFrame:
    orders = revenue.per_hotel_spread(read(spark, folder, "orders"), "o_custkey")
    suppliers = revenue.per_hotel_spread(read(spark, folder, "supplier"), "s_nationkey")
    return orders.select(F.lit("orders per customer").alias("what"), "*").unionByName(
        suppliers.select(F.lit("suppliers per nation").alias("what"), "*")
    )


@query(
    """SELECT o_orderkey AS BookingID FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def unreviewed_bookings(spark: SparkSession, folder: str) -> DataFrame:
    return revenue.without_review(
        bookings(spark, folder).select("BookingID"), rooms(spark, folder)
    )


@query(
    """SELECT min(o_orderkey) AS BookingID FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def first_unreviewed_booking(spark: SparkSession, folder: str) -> DataFrame:
    return unreviewed_bookings(spark, folder).orderBy("BookingID").limit(1)
