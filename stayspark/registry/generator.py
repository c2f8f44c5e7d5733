"""The data generator with one generated row per order: row number = order key + 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.operators import billing
from stayspark.operators.lookup import same_content, value_types
from stayspark.operators.unions import union_all
from stayspark.plans import revenue
from stayspark.registry.base import query, read, sql_percent
from stayspark.sources import generator as gen
from stayspark.sources.sample import sample_table

# Any number of orders stays below this; the customers who book are those of the published data set.
SECOND_ROOMS = 1_000_000_000_000
CUSTOMERS = gen.DEFAULT_SIZE + gen.HAND_CUSTOMERS


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    numbers = read(spark, folder, "orders").select((F.col("o_orderkey") + 1).alias("n"))
    return gen.with_hashes(numbers)


def _rooms(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    return gen.primary_rooms(rows).unionByName(gen.second_rooms(rows, SECOND_ROOMS))


def _pick(values: tuple, index: str) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{listed}], CAST({index} AS BIGINT) + 1)"


# The same arithmetic as SQL, written out so that it checks the operator.
_BASE = f"""
WITH numbered AS (SELECT o_orderkey + 1 AS n FROM orders),
hashed AS (
  SELECT n,
    (((n * 2654435761 + 1013904223) % 1000003) * ((n * 40503 + 12345) % 999983)) % 4294967291 AS h,
    (((n * 1103515245 + 12345) % 1000033) * ((n * 22695477 + 1) % 999979)) % 4294967291 AS h2
  FROM numbered),
g AS (
  SELECT *, 4001 + h % 10 AS hid, {_pick(gen.BASE_PRICE, "h % 10")} AS base_price,
    {_pick(gen.CANCEL_PCT, "h % 10")} AS cancel_pct,
    {_pick(gen.RATING_BASE, "h % 10")} AS rating_base FROM hashed),
booking AS (
  SELECT 1000010 + n AS "BookingID",
    DATE '2023-01-01' + CAST((h // 20000) % 730 AS INTEGER) AS "Arrival_date",
    DATE '2023-01-01' + CAST((h // 20000) % 730 + 1 + (h // 1000) % 14 AS INTEGER)
      AS "Checkout_date",
    CASE WHEN (h // 10) % 100 < cancel_pct THEN 1 ELSE 0 END AS "Cancellation",
    CAST(1 + (h // 1000) % 14 AS INTEGER) AS "Duration",
    CAST(1 + (h2 // 3) % 4 AS INTEGER) AS "Number_of_guests",
    CAST((h2 // 11) % 2 AS INTEGER) AS "Meal",
    1001 + h2 % {CUSTOMERS} AS "CustomerCustomerID", hid AS "HotelHotelID" FROM g),
room AS (
  SELECT 10000 + n AS "Room_number", {_pick(gen.ROOM_TYPES, "(h2 // 17) % 4")} AS "Room_type",
    CAST(base_price - 20 + (h // 41) % 41 AS BIGINT) AS "Price", hid AS "HotelHotelID",
    1000010 + n AS "BookingBookingID" FROM g
  UNION ALL
  SELECT 1000000000000 + n, {_pick(gen.ROOM_TYPES, "(h // 17) % 4")},
    CAST(base_price - 20 + (h2 // 41) % 41 AS BIGINT), hid, 1000010 + n
  FROM g WHERE (h2 // 23) % 5 = 0),
amount AS (
  SELECT "BookingID", CAST(sum("Duration" * "Price") AS BIGINT) AS amount
  FROM booking JOIN room ON "BookingBookingID" = "BookingID" GROUP BY "BookingID"),
review AS (
  SELECT 1000 + n AS "FeedbackID", 1000010 + n AS "BookingBookingID", hid AS "HotelHotelID",
    CAST(greatest(1, least(5, rating_base - 1 + (h // 17) % 3)) AS INTEGER) AS "Rating"
  FROM g WHERE (h // 10) % 100 >= cancel_pct AND (h2 // 29) % 10 < 7)
"""


@query(
    _BASE
    + f"""SELECT 1010 + n AS "CustomerID",
  {_pick(gen.FIRST_NAMES, "(h // 7) % 20")} AS "First_name",
  {_pick(gen.LAST_NAMES, "(h2 // 137) % 20")} AS "Last_name",
  CAST(1 + (h2 // 7) % 250 AS VARCHAR) || ' ' || {_pick(gen.STREETS, "(h2 // 13) % 4")}
    AS "Address",
  'N' || CAST(1 + (h // 3) % 9 AS VARCHAR) || ' ' || CAST(1 + (h // 19) % 9 AS VARCHAR) || 'AB'
    AS "Postal_code",
  '7' || lpad(CAST((h2 // 11) % 1000000000 AS VARCHAR), 9, '0') AS "Contact_number",
  CAST(18 + (h // 23) % 62 AS INTEGER) AS "Age" FROM g"""
)
def gen_customers(spark: SparkSession, folder: str) -> DataFrame:
    return gen.customers(_rows(spark, folder))


@query(_BASE + "SELECT * FROM booking")
def gen_bookings(spark: SparkSession, folder: str) -> DataFrame:
    return billing.with_nights(gen.bookings(_rows(spark, folder), CUSTOMERS))


@query(_BASE + "SELECT * FROM room")
def gen_rooms(spark: SparkSession, folder: str) -> DataFrame:
    return _rooms(spark, folder)


@query(
    _BASE
    + """SELECT 3000 + n AS "InvoiceID", 1000010 + n AS "BookingBookingID",
  coalesce(amount, 0) AS "Amount", (h // 31) % 61 AS "Discount", "Checkout_date" AS "Date",
  lpad(CAST((h2 // 53) % 24 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST((h // 59) % 60 AS VARCHAR), 2, '0') AS "Time"
FROM g JOIN booking ON "BookingID" = 1000010 + n LEFT JOIN amount USING ("BookingID")"""
)
def gen_invoices(spark: SparkSession, folder: str) -> DataFrame:
    bookings = billing.with_nights(gen.bookings(_rows(spark, folder), CUSTOMERS))
    return billing.with_amounts(
        gen.invoices(_rows(spark, folder)), bookings, _rooms(spark, folder)
    )


@query(
    _BASE
    + f"""SELECT "FeedbackID", "BookingBookingID",
  {_pick(gen.REVIEWS, '"Rating" - 1')} AS "Feedback_text", "Rating", "HotelHotelID" FROM review"""
)
def gen_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return gen.feedback(_rows(spark, folder))


@query(
    _BASE
    + f""", hotel AS (
  SELECT "HotelHotelID" AS hotel_id, count(*) AS bookings,
    CAST(sum("Cancellation") AS BIGINT) AS cancelled, CAST(sum(amount) AS BIGINT) AS booked_revenue,
    CAST(sum(CASE WHEN "Cancellation" = 1 THEN amount ELSE 0 END) AS BIGINT) AS lost_revenue,
    CAST(sum(CASE WHEN "Cancellation" = 0 THEN amount ELSE 0 END) AS BIGINT) AS realised_revenue
  FROM booking JOIN amount USING ("BookingID") GROUP BY "HotelHotelID"),
rated AS (
  SELECT "HotelHotelID" AS hid, count(*) AS reviews,
    round(CAST(avg("Rating") AS DECIMAL(18,6)), 2) AS avg_rating FROM review GROUP BY hid)
SELECT hotel_id, bookings, cancelled, booked_revenue, lost_revenue, realised_revenue,
  CAST(avg_rating AS DECIMAL(18,2)) AS avg_rating, coalesce(reviews, 0) AS reviews,
  {sql_percent("cancelled", "bookings")} AS cancel_rate_pct,
  {sql_percent("lost_revenue", "booked_revenue")} AS lost_share_pct
FROM hotel LEFT JOIN rated ON hid = hotel_id"""
)
def gen_revenue_at_risk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    bookings = billing.with_nights(gen.bookings(rows, CUSTOMERS))
    invoices = billing.with_amounts(gen.invoices(rows), bookings, _rooms(spark, folder))
    risk = revenue.hotel_revenue_at_risk(
        sample_table(spark, "Hotel"), bookings, invoices, gen.feedback(rows)
    )
    return risk.drop("hotel")


@query(
    _BASE
    + """SELECT count(*) AS row_count, min(h) AS h_min, max(h) AS h_max, min(h2) AS h2_min,
  max(h2) AS h2_max FROM hashed"""
)
def gen_hash_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return gen.hash_bounds(_rows(spark, folder).select("n"))


@query(_BASE + "SELECT DISTINCT lower(typeof(h)) AS h, lower(typeof(h2)) AS h2 FROM hashed")
def gen_hash_types(spark: SparkSession, folder: str) -> DataFrame:
    return value_types(_rows(spark, folder), "h", "h2")


@query(
    _BASE
    + """SELECT 'Booking' AS table_name, count(*) AS row_count, TRUE AS same FROM booking
UNION ALL SELECT 'Room', count(*), TRUE FROM room
UNION ALL SELECT 'Feedback', count(*), TRUE FROM review"""
)
def gen_two_builds(spark: SparkSession, folder: str) -> DataFrame:
    """Two builds, the second from rows dealt out otherwise, have the same content."""

    def build(rows: DataFrame) -> dict[str, DataFrame]:
        return {
            "Booking": billing.with_nights(gen.bookings(rows, CUSTOMERS)),
            "Room": gen.primary_rooms(rows).unionByName(gen.second_rooms(rows, SECOND_ROOMS)),
            "Feedback": gen.feedback(rows),
        }

    numbers = read(spark, folder, "orders").select((F.col("o_orderkey") + 1).alias("n"))
    first = build(gen.with_hashes(numbers))
    second = build(gen.with_hashes(numbers.repartition(7, "n")))
    return union_all(
        same_content(first[name], second[name]).select(F.lit(name).alias("table_name"), "*")
        for name in first
    )
