"""The risk table and its summaries, kept up to date from deltas.

A state is sums per hotel that can be added to and taken from; what is reported is worked out from the sums.
Sums are of whole cents and points, so a state that followed any number of deltas is that of a new start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayspark.functions.numbers import percent, ratio, rounded
from stayspark.operators.deltas import CHANGE, joined_delta, signed, sums, value_of
from stayspark.operators.unions import union_all
from stayspark.plans.revenue import MEASURES, risk_table

_AMOUNTS = MEASURES[1:]
_COUNTS = ("bookings", "reviews")


def _kinds(frame: DataFrame) -> list:
    """How columns of a state are put together: all but the key are summed in their own type."""
    return [F.sum(c).cast(kind).alias(c) for c, kind in frame.dtypes if c != "hotel_id"]


def facts_delta(
    bookings: DataFrame, booking_delta: DataFrame, invoices: DataFrame, invoice_delta: DataFrame
) -> DataFrame:
    """Delta of the invoiced bookings: (hotel_id, cancelled, amount).

    ``bookings`` and ``invoices`` are the tables as they are now, or all their rows of the touched bookings.
    """

    def booked(frame: DataFrame, *more: str) -> DataFrame:
        return frame.select(
            "BookingID", F.col("HotelHotelID").alias("hotel_id"), F.col("Cancellation").alias("cancelled"), *more
        )

    def billed(frame: DataFrame, *more: str) -> DataFrame:
        return frame.select(
            F.col("BookingBookingID").alias("BookingID"), F.col("Amount").alias("amount"), *more
        )

    return joined_delta(
        booked(bookings), booked(booking_delta, CHANGE), billed(invoices), billed(invoice_delta, CHANGE), "BookingID"
    ).select("hotel_id", "cancelled", "amount", CHANGE)


def hotel_state(facts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Sums per hotel over a delta of facts (hotel_id, cancelled, amount) and one of reviews (hotel_id, rating)."""
    split = facts.select(
        "hotel_id",
        CHANGE,
        F.lit(1).alias("bookings"),
        F.col("cancelled").cast("bigint").alias("cancelled"),
        F.col("amount").alias("booked_revenue"),
        F.expr("CASE WHEN cancelled = 1 THEN amount ELSE 0 END AS lost_revenue"),
        F.expr("CASE WHEN cancelled = 0 THEN amount ELSE 0 END AS realised_revenue"),
        F.lit(None).cast("bigint").alias("rating"),
        F.lit(0).alias("reviews"),
    )
    rated = feedback.select(
        "hotel_id",
        CHANGE,
        F.lit(0).alias("bookings"),
        *[F.lit(None).cast("bigint").alias(c) for c in _AMOUNTS],
        F.col("rating").cast("bigint").alias("rating"),
        F.lit(1).alias("reviews"),
    )
    counts = [F.sum(F.col(CHANGE) * F.col(c)).cast("bigint").alias(c) for c in _COUNTS]
    both = split.unionByName(rated).where("hotel_id IS NOT NULL")
    return both.groupBy("hotel_id").agg(*counts, *sums((*_AMOUNTS, "rating")))


def merged(*states: DataFrame) -> DataFrame:
    """States put together; hotels that nothing is left of go."""
    together = union_all(states)
    return together.groupBy("hotel_id").agg(*_kinds(states[0])).where("bookings <> 0 OR reviews <> 0")


def risk_of(hotels: DataFrame, state: DataFrame, unit: int = 1) -> DataFrame:
    """The risk table of ``hotels`` (hotel_id, hotel), as ``revenue.risk_table`` gives it."""
    per_hotel = state.where("bookings > 0").select(
        "hotel_id", "bookings", *[value_of(c).alias(c) for c in _AMOUNTS]
    )
    average = ratio(value_of("rating"), F.col("rating_known") * F.lit(unit))
    rated = state.where("reviews > 0").select("hotel_id", rounded(average, 2).alias("avg_rating"), "reviews")
    return risk_table(hotels, per_hotel, rated)


def summary_of(risk: DataFrame) -> DataFrame:
    """One row of sums over a delta of the risk table, or over one marked as all new.

    Beside the totals it holds the moments of rating (in hundredths) and cancellation rate (in tenths).
    """
    x = (F.col("avg_rating") * 100).cast("decimal(19,0)")
    y = (F.col("cancel_rate_pct") * 10).cast("decimal(19,0)")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    rows = risk.select(
        CHANGE, F.lit(1).alias("hotels"), "bookings", "booked_revenue", "lost_revenue",
        x.alias("x"), y.alias("y"), (x * x).alias("xx"), (x * y).alias("xy"), (y * y).alias("yy"),
    )
    wide = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("x", "y", "xx", "xy", "yy")]
    rows = rows.select(CHANGE, "hotels", "bookings", "booked_revenue", "lost_revenue", *wide)
    return rows.agg(
        F.coalesce(F.sum(F.col(CHANGE) * F.col("hotels")), F.lit(0)).cast("bigint").alias("hotels"),
        *sums(("bookings", "booked_revenue", "lost_revenue")),
        *[
            F.coalesce(F.sum(F.when(F.col(CHANGE) > 0, F.col(c)).otherwise(-F.col(c))), F.lit(0))
            .cast("decimal(38,0)").alias(c)
            for c in ("x", "y", "xx", "xy", "yy")
        ],
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col(CHANGE))), F.lit(0)).cast("bigint").alias("pairs"),
    )


def summaries_merged(*summaries: DataFrame) -> DataFrame:
    return union_all(summaries).agg(*_kinds(summaries[0]))


def changed_risk(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """Delta of the risk table, of which only the touched hotels' rows can differ."""
    return signed(before.join(touched, "hotel_id", "left_semi"), -1).unionByName(
        signed(after.join(touched, "hotel_id", "left_semi"), 1)
    )


def totals_of(summary: DataFrame) -> DataFrame:
    """What ``revenue.portfolio_totals`` gives."""
    totals = summary.select(
        "hotels", *[value_of(c).alias(c) for c in ("bookings", "booked_revenue", "lost_revenue")]
    )
    return totals.withColumn("lost_pct", percent(F.col("lost_revenue"), F.col("booked_revenue")))


def correlation_of(summary: DataFrame) -> DataFrame:
    """What ``revenue.rating_correlation`` gives, from exact moments."""
    n = F.col("pairs").cast("decimal(19,0)")

    def moment(product: str, a: str, b: str):
        return (n * F.col(product) - F.col(a) * F.col(b)).cast("double")

    spread = F.sqrt(moment("xx", "x", "x")) * F.sqrt(moment("yy", "y", "y"))
    return summary.select("hotels", rounded(F.try_divide(moment("xy", "x", "y"), spread), 6).alias("r"))
