"""Revenue lost to cancellations: per hotel, for the portfolio, and what the rankings say.

Sums are taken per key before anything is joined to that key, so the joins carry one row per
hotel (or per customer) instead of one row per booking, and a hotel with a third of all bookings
is folded inside the map tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayspark.functions.numbers import pearson, percent, ratio, rounded

MEASURES = ("bookings", "cancelled", "booked_revenue", "lost_revenue", "realised_revenue")


def booking_facts(bookings: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row per invoiced booking: hotel, cancellation flag, amount."""
    return bookings.select(
        "BookingID", F.col("HotelHotelID").alias("hotel_id"), F.col("Cancellation").alias("cancelled")
    ).join(
        invoices.select(
            F.col("BookingBookingID").alias("BookingID"), F.col("Amount").alias("amount")
        ),
        "BookingID",
    )


def measures(facts: DataFrame, key: str) -> DataFrame:
    """Bookings and revenue per key.  A NULL flag counts as booked, neither lost nor realised."""

    return facts.groupBy(key).agg(
        F.expr("count(1) AS bookings"),
        F.expr("sum(cancelled) AS cancelled"),
        F.expr("sum(amount) AS booked_revenue"),
        F.expr("sum(CASE WHEN cancelled = 1 THEN amount ELSE 0 END) AS lost_revenue"),
        F.expr("sum(CASE WHEN cancelled = 0 THEN amount ELSE 0 END) AS realised_revenue"),
    )


def roll_up(frame: DataFrame, owners: DataFrame, key: str, to: str) -> DataFrame:
    """Re-sum measures from ``key`` to ``to``; ``owners`` maps every key to one ``to``."""
    return frame.join(owners, key).groupBy(to).agg(*[F.expr(f"sum({m}) AS {m}") for m in MEASURES])


def ratings(feedback: DataFrame, unit: int = 1) -> DataFrame:
    """Average rating and number of reviews per hotel; ``unit`` is what one point counts as."""
    average = ratio(F.sum("Rating"), F.count("Rating") * F.lit(unit))
    return feedback.groupBy(F.col("HotelHotelID").alias("hotel_id")).agg(
        rounded(average, 2).alias("avg_rating"), F.count(F.lit(1)).alias("reviews")
    )


def risk_table(hotels: DataFrame, per_hotel: DataFrame, rated: DataFrame) -> DataFrame:
    """Measures and ratings side by side; hotels without an invoiced booking drop out."""
    return (
        hotels.select("hotel_id", "hotel")
        .join(per_hotel, "hotel_id")
        .join(rated, "hotel_id", "left")
        .select(
            "hotel_id",
            "hotel",
            *MEASURES,
            "avg_rating",
            F.coalesce("reviews", F.lit(0).cast("bigint")).alias("reviews"),
            percent(F.col("cancelled"), F.col("bookings")).alias("cancel_rate_pct"),
            percent(F.col("lost_revenue"), F.col("booked_revenue")).alias("lost_share_pct"),
        )
    )


def hotel_revenue_at_risk(
    hotels: DataFrame, bookings: DataFrame, invoices: DataFrame, feedback: DataFrame
) -> DataFrame:
    """The per-hotel table over the six-table model, not yet sorted."""
    named = hotels.select(F.col("HotelID").alias("hotel_id"), F.col("Name").alias("hotel"))
    return risk_table(named, measures(booking_facts(bookings, invoices), "hotel_id"), ratings(feedback))


def worst_first(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("lost_revenue"), "hotel_id")


def smallest_loss_first(frame: DataFrame) -> DataFrame:
    """What a bar chart of losses is drawn from."""
    return frame.select("hotel_id", "hotel", "lost_revenue").orderBy("lost_revenue", "hotel_id")


def portfolio_totals(frame: DataFrame) -> DataFrame:
    totals = frame.agg(
        F.count(F.lit(1)).alias("hotels"),
        F.sum("bookings").alias("bookings"),
        F.sum("booked_revenue").alias("booked_revenue"),
        F.sum("lost_revenue").alias("lost_revenue"),
    )
    return totals.withColumn(
        "lost_pct", percent(F.col("lost_revenue"), F.col("booked_revenue"))
    )


def loss_concentration(frame: DataFrame, k: int = 3) -> DataFrame:
    """What share of the loss, and of the bookings, the k worst hotels hold.

    ``frame`` is read twice; pass one that is stored (see ``session.durable``).
    """
    totals = frame.agg(F.sum("lost_revenue").alias("lost"), F.sum("bookings").alias("bookings"))
    top = worst_first(frame).limit(k)
    total_lost, total_bookings = totals.select("lost").scalar(), totals.select("bookings").scalar()
    return top.agg(
        F.count(F.lit(1)).alias("hotels"),
        F.sum("lost_revenue").alias("top_lost_revenue"),
        F.sum("bookings").alias("top_bookings"),
    ).select(
        "hotels",
        "top_lost_revenue",
        "top_bookings",
        percent(F.col("top_lost_revenue"), total_lost).alias("share_of_loss_pct"),
        percent(F.col("top_bookings"), total_bookings).alias("share_of_bookings_pct"),
    )


def rating_correlation(frame: DataFrame) -> DataFrame:
    """Pearson r of average rating and cancellation rate over the hotels."""
    return frame.agg(
        F.count(F.lit(1)).alias("hotels"),
        rounded(pearson(F.col("avg_rating"), F.col("cancel_rate_pct")), 6).alias("r"),
    )


def rank_disagreement(frame: DataFrame) -> DataFrame:
    """The worst hotel by rate, the worst by money, and whether they are the same one."""
    entry = F.struct("hotel_id", "hotel", "cancel_rate_pct", "lost_revenue")
    # The key is part of the order, negated: the smaller key wins a tie.
    by_rate = F.max_by(entry, F.struct("cancel_rate_pct", -F.col("hotel_id")))
    by_money = F.max_by(entry, F.struct("lost_revenue", -F.col("hotel_id")))
    picked = frame.agg(by_rate.alias("rate"), by_money.alias("money"))
    return picked.select(
        F.col("rate.hotel").alias("worst_by_rate"),
        F.col("rate.cancel_rate_pct").alias("worst_rate_pct"),
        F.col("rate.lost_revenue").alias("worst_rate_lost"),
        F.col("money.hotel").alias("worst_by_money"),
        F.col("money.cancel_rate_pct").alias("worst_money_pct"),
        F.col("money.lost_revenue").alias("worst_money_lost"),
        (F.col("rate.hotel_id") == F.col("money.hotel_id")).alias("same_hotel"),
    )


def identity_violations(frame: DataFrame) -> DataFrame:
    """Hotels where booked revenue is not lost plus realised: some booking has no flag."""
    split = F.col("lost_revenue") + F.col("realised_revenue")
    return frame.where(F.col("booked_revenue") != split).select(
        "hotel_id",
        "booked_revenue",
        "lost_revenue",
        "realised_revenue",
        (F.col("booked_revenue") - split).alias("unexplained"),
    )


def reconcile(frame: DataFrame, bookings: DataFrame, invoices: DataFrame) -> DataFrame:
    """Report totals beside totals taken straight from the invoices, and their differences."""
    report = frame.agg(
        F.sum("booked_revenue").alias("report_booked"), F.sum("lost_revenue").alias("report_lost")
    )
    booked = invoices.agg(F.sum("Amount").alias("v")).scalar()
    cancelled = bookings.where("Cancellation = 1").select(F.col("BookingID").alias("BookingBookingID"))
    lost = (
        invoices.join(cancelled, "BookingBookingID", "left_semi").agg(F.sum("Amount").alias("v")).scalar()
    )
    return report.withColumns({"invoice_booked": booked, "invoice_lost": lost}).withColumns(
        {
            "booked_difference": F.col("report_booked") - F.col("invoice_booked"),
            "lost_difference": F.col("report_lost") - F.col("invoice_lost"),
        }
    )


def per_hotel_spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key: number of keys, smallest and largest count."""
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("hotels"),
            F.min("n").alias("min_rows"),
            F.max("n").alias("max_rows"),
        )
    )


def without_review(bookings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Bookings nobody reviewed."""
    reviewed = (
        feedback.where(F.col("BookingBookingID").isNotNull())
        .select(F.col("BookingBookingID").alias("BookingID"))
        .distinct()
    )
    return bookings.join(reviewed, "BookingID", "left_anti")
