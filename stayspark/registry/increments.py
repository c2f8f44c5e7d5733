"""A batch of changes to stored tables: amounts and risk figures of what it touches, and where two builds differ.

Bookings reach their hotel through the customer, as everywhere here.  The batch lengthens and cancels the latest
stays, drops the first bookings with their invoices, and takes away, moves and reprices rooms in the middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import minor_units, money
from stayspark.operators import differences
from stayspark.operators.billing import with_amounts, with_nights
from stayspark.operators.deltas import CHANGE, signed
from stayspark.plans import increments, risk_state
from stayspark.plans.revenue import booking_facts
from stayspark.registry.base import LINE_PRICE, invoices, query, read, sql_money, sql_percent, stays
from stayspark.session import durable, scratch_folder
from stayspark.sources.slices import Sliced, slice_numbers

# Stored tables are cut into about so many slices here.
_SLICES = 64

# The batch, as both engines say it; ``top`` is the largest key.
_LATE, _FIRST = "{key} > top * 0.98", "{key} <= top * 0.01"
_MIDDLE = "{key} BETWEEN top * 0.5 AND top * 0.51"


def _top(spark: SparkSession, folder: str) -> int:
    return read(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0] or 0


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Bookings, rooms and invoices with nights and amounts derived."""
    owners = read(spark, folder, "customer").selectExpr("c_custkey AS CustomerCustomerID", "c_nationkey AS HotelHotelID")
    booked = with_nights(stays(spark, folder).join(owners, "CustomerCustomerID", "left"))
    lines = read(spark, folder, "lineitem")
    rooms = lines.select(
        # The whole line, as line numbers repeat: lines that are equal all over change together.
        F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in lines.columns]).alias("Room_number"),
        F.col("l_orderkey").alias("BookingBookingID"),
        minor_units(F.col("l_extendedprice")).alias("Price"),
        F.col("l_returnflag").alias("Kind"),
    )
    billed = with_amounts(invoices(spark, folder), booked, rooms)
    return {"Booking": booked, "Room": rooms, "Invoice": billed}


def _batch(stored: dict[str, Sliced], spark: SparkSession, top: int) -> dict[str, DataFrame]:
    """The batch as deltas, read from the slices in which it lies."""

    def rows(name: str, condition: str) -> DataFrame:
        table = stored[name]
        chosen = condition.replace("top", str(top)).format(key=table.key)
        bounds = table.read(spark).where(chosen).agg(F.min(table.key), F.max(table.key)).first()
        if bounds[0] is None:
            return table.read(spark, [])
        return table.read(spark, range(bounds[0] // table.width, bounds[1] // table.width + 1)).where(chosen)

    late, first = rows("Booking", _LATE), rows("Booking", _FIRST)
    longer = late.withColumns({
        "Checkout_date": F.date_add("Checkout_date", 2),
        "Cancellation": F.when(F.col("Cancellation") == 0, 1).otherwise(F.col("Cancellation")),
    })
    middle = rows("Room", _MIDDLE)
    kept = middle.where("Kind <> 'R'").withColumns({
        "BookingBookingID": F.col("BookingBookingID") + F.when(F.col("Kind") == "A", 1).otherwise(0),
        "Price": F.col("Price") + F.when(F.col("Kind") == "N", 1000).otherwise(0),
    })
    middle = middle.where("Kind IS NOT NULL")
    return {
        "Booking": signed(late, -1).unionByName(signed(longer, 1)).unionByName(signed(first, -1)),
        "Room": signed(middle, -1).unionByName(signed(kept, 1)),
        "Invoice": signed(rows("Invoice", _FIRST), -1),
    }


def _sql_when(condition: str, key: str) -> str:
    return condition.replace("top", "(SELECT max(o_orderkey) FROM orders)").format(key=key)


_CHANGED = f"""
WITH lines AS (
  SELECT CASE WHEN {_sql_when(_MIDDLE, "l_orderkey")} AND l_returnflag = 'A' THEN l_orderkey + 1 ELSE l_orderkey END
           AS l_orderkey,
         {LINE_PRICE} + CASE WHEN {_sql_when(_MIDDLE, "l_orderkey")} AND l_returnflag = 'N' THEN 10 ELSE 0 END AS price
  FROM lineitem WHERE NOT coalesce({_sql_when(_MIDDLE, "l_orderkey")} AND l_returnflag = 'R', FALSE)),
nightly AS (SELECT l_orderkey, sum(price) AS price FROM lines GROUP BY l_orderkey),
stays AS (
  SELECT o_orderkey, c_nationkey AS hotel_id,
         coalesce((1 + o_custkey % 14 + CASE WHEN {_sql_when(_LATE, "o_orderkey")} THEN 2 ELSE 0 END) * price, 0) AS amount,
         CASE WHEN o_orderstatus = 'F' THEN 1
              WHEN o_orderstatus = 'O' THEN CASE WHEN {_sql_when(_LATE, "o_orderkey")} THEN 1 ELSE 0 END END AS cancelled
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nightly ON l_orderkey = o_orderkey
  WHERE NOT {_sql_when(_FIRST, "o_orderkey")}),
per_hotel AS (
  SELECT hotel_id, count(*) AS bookings, CAST(sum(cancelled) AS BIGINT) AS cancelled, sum(amount) AS booked_revenue,
         sum(CASE WHEN cancelled = 1 THEN amount ELSE 0 END) AS lost_revenue,
         sum(CASE WHEN cancelled = 0 THEN amount ELSE 0 END) AS realised_revenue
  FROM stays GROUP BY hotel_id),
rated AS (
  SELECT s_nationkey, count(*) AS reviews,
         round(CAST(avg(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,6)), 2) AS avg_rating
  FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey),
risk AS (
  SELECT n_nationkey AS hotel_id, n_name AS hotel, bookings, cancelled, booked_revenue, lost_revenue, realised_revenue,
         avg_rating, coalesce(reviews, 0) AS reviews, {sql_percent("cancelled", "bookings")} AS cancel_rate_pct,
         {sql_percent("lost_revenue", "booked_revenue")} AS lost_share_pct
  FROM nation JOIN per_hotel ON hotel_id = n_nationkey LEFT JOIN rated ON s_nationkey = n_nationkey)
"""


def _stored(spark: SparkSession, folder: str, scratch: str, top: int) -> dict[str, Sliced]:
    return increments.store(_tables(spark, folder), scratch, top // _SLICES + 1)


@query(_CHANGED + f"""SELECT o_orderkey AS "InvoiceID", {sql_money("amount")} AS "Amount" FROM stays""")
def recompute_touched(spark: SparkSession, folder: str) -> DataFrame:
    """All invoices after the batch, of which only those in touched slices were read again."""
    with scratch_folder(spark, "stays") as scratch:
        top = _top(spark, folder)
        stored = _stored(spark, folder, scratch, top)
        increments.recompute_touched(spark, stored, _batch(stored, spark, top))
        left = stored["Invoice"].read(spark).select("InvoiceID", money(F.col("Amount")).alias("Amount"))
        return durable(left)


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("hotel_id"), minor_units(F.col("s_acctbal")).alias("rating")
    )


def _risk(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The risk table before the batch, and its delta: states are merged, nothing is counted anew."""
    hotels = read(spark, folder, "nation").selectExpr("n_nationkey AS hotel_id", "n_name AS hotel")
    reviews = signed(_reviews(spark, folder), 1)
    with scratch_folder(spark, "stays") as scratch:
        top = _top(spark, folder)
        stored = _stored(spark, folder, scratch, top)
        facts = booking_facts(stored["Booking"].read(spark), stored["Invoice"].read(spark))
        before = durable(risk_state.hotel_state(signed(facts, 1), reviews))
        deltas = increments.recompute_touched(spark, stored, _batch(stored, spark, top))
        touched = deltas["Booking"].select("BookingID").union(deltas["Invoice"].select("BookingBookingID"))
        slices = slice_numbers(touched, stored["Booking"].width)
        changed = risk_state.facts_delta(
            stored["Booking"].read(spark, slices), deltas["Booking"],
            stored["Invoice"].read(spark, slices), deltas["Invoice"],
        )
        withdrawn = signed(_reviews(spark, folder).where("rating < 0"), -1)
        delta = durable(risk_state.hotel_state(changed, withdrawn))
    first = risk_state.risk_of(hotels, before, unit=100)
    second = risk_state.risk_of(hotels, risk_state.merged(before, delta), unit=100)
    return first, durable(risk_state.changed_risk(first, second, delta.select("hotel_id")))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    before, delta = _risk(spark, folder)
    return risk_state.summaries_merged(risk_state.summary_of(signed(before, 1)), risk_state.summary_of(delta))


_MONEY = ("booked_revenue", "lost_revenue", "realised_revenue")


@query(
    _CHANGED
    + f"""SELECT hotel_id, hotel, bookings, cancelled, {", ".join(f"{sql_money(m)} AS {m}" for m in _MONEY)},
  CAST(avg_rating AS DECIMAL(18,2)) AS avg_rating, reviews, cancel_rate_pct, lost_share_pct FROM risk"""
)
def risk_after_batch(spark: SparkSession, folder: str) -> DataFrame:
    before, delta = _risk(spark, folder)
    gone, now = (delta.where(f"{CHANGE} = {sign}").drop(CHANGE) for sign in (-1, 1))
    after = before.join(gone.select("hotel_id"), "hotel_id", "left_anti").unionByName(now)
    return after.withColumns({m: money(F.col(m)) for m in _MONEY})


@query(
    _CHANGED
    + f"""SELECT count(*) AS hotels, CAST(sum(bookings) AS BIGINT) AS bookings,
  {sql_money("sum(booked_revenue)")} AS booked_revenue, {sql_money("sum(lost_revenue)")} AS lost_revenue,
  {sql_percent("sum(lost_revenue)", "sum(booked_revenue)")} AS lost_pct FROM risk"""
)
def portfolio_after_batch(spark: SparkSession, folder: str) -> DataFrame:
    totals = risk_state.totals_of(_summary(spark, folder))
    return totals.withColumns({m: money(F.col(m)) for m in _MONEY[:2]})


@query(
    _CHANGED
    + """SELECT count(*) AS hotels, CAST(round(CAST(
  corr(CAST(avg_rating AS DOUBLE), CAST(cancel_rate_pct AS DOUBLE)) AS DECIMAL(18,9)), 6) AS DECIMAL(18,6)) AS r
FROM risk"""
)
def correlation_after_batch(spark: SparkSession, folder: str) -> DataFrame:
    return risk_state.correlation_of(_summary(spark, folder))


@query(
    """WITH orders2 AS (
  SELECT CASE WHEN {first} AND o_orderstatus = 'O' THEN o_orderkey + 2 * top ELSE o_orderkey END AS o_orderkey,
         o_custkey, o_orderstatus, CASE WHEN {late} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders, (SELECT max(o_orderkey) AS top FROM orders)
  WHERE NOT coalesce({middle} AND o_orderstatus = 'F', FALSE))
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key,
  CASE WHEN b.o_orderkey IS NULL THEN 'lost' WHEN a.o_orderkey IS NULL THEN 'new' ELSE 'changed' END AS change,
  CAST(a.o_orderkey IS NOT NULL AS BIGINT) AS first_rows, CAST(b.o_orderkey IS NOT NULL AS BIGINT) AS second_rows
FROM orders a FULL JOIN orders2 b ON a.o_orderkey = b.o_orderkey
WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice""".format(
        **{n: c.format(key="o_orderkey") for n, c in (("first", _FIRST), ("late", _LATE), ("middle", _MIDDLE))}
    )
)
def build_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against a second build in which some have changed, moved to other keys, or are lost."""
    first = read(spark, folder, "orders")
    top = _top(spark, folder)
    early, late, middle = (
        F.expr(c.replace("top", str(top)).format(key="o_orderkey")) for c in (_FIRST, _LATE, _MIDDLE)
    )
    second = first.where(~F.coalesce(middle & F.expr("o_orderstatus = 'F'"), F.lit(False))).withColumns({
        "o_orderkey": F.col("o_orderkey") + F.when(early & F.expr("o_orderstatus = 'O'"), 2 * top).otherwise(0),
        "o_totalprice": F.col("o_totalprice") + F.when(late, 1).otherwise(0),
    })
    with scratch_folder(spark, "builds") as scratch:
        builds = []
        for name, table in (("first", first), ("second", second)):
            build = Sliced(f"{scratch}/{name}", "o_orderkey", top // _SLICES + 1, table.schema)
            build.write(table)
            tree = durable(differences.content_tree(build.read(spark), build.key, build.width))
            builds.append((build, tree))
        (one, one_tree), (two, two_tree) = builds
        return durable(differences.compare(spark, one, two, one_tree, two_tree))
