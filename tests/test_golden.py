"""Published results of the 250-booking data set."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayspark.model import TABLES
from stayspark.operators import billing
from stayspark.plans import revenue


def one(df):
    (row,) = df.collect()
    return row


@pytest.fixture(scope="module")
def risk(tables):
    return revenue.hotel_revenue_at_risk(
        tables["Hotel"], tables["Booking"], tables["Invoice"], tables["Feedback"]
    ).cache()


def test_row_counts(tables):
    counts = {name: t.count() for name, t in tables.items()}
    assert counts == {
        "Hotel": 10, "Customer": 250, "Booking": 250, "Room": 298, "Invoice": 250, "Feedback": 152,
    }


# hotel, bookings, cancel rate, booked, lost, lost share, rating, reviews
PER_HOTEL = [
    ("Hampton by Hilton London Waterloo", 29, "27.6", 75252, 22563, "30.0", "1.31", 13),
    ("Grand Royale London Hyde Park", 29, "20.7", 52266, 14857, "28.4", "2.15", 20),
    ("Astor Court Hotel", 29, "20.7", 38026, 7891, "20.8", "3.00", 19),
    ("The Montana", 20, "30.0", 21435, 3125, "14.6", "1.30", 10),
    ("New Linden Hotel", 18, "11.1", 31964, 2660, "8.3", "4.00", 10),
    ("Crowne Plaza London Ealing", 20, "10.0", 17569, 2115, "12.0", "1.75", 8),
    ("The 29 London", 28, "3.6", 25066, 1240, "4.9", "3.67", 18),
    ("Sea Containers London", 18, "5.6", 42791, 1040, "2.4", "4.00", 12),
    ("Park Grand London Hyde Park", 28, "3.6", 71999, 956, "1.3", "4.84", 19),
    ("Dorsett City London", 31, "3.2", 26216, 111, "0.4", "4.78", 23),
]


def test_per_hotel_table(risk):
    got = [
        (
            r.hotel,
            r.bookings,
            str(r.cancel_rate_pct),
            r.booked_revenue,
            r.lost_revenue,
            str(r.lost_share_pct),
            str(r.avg_rating),
            r.reviews,
        )
        for r in revenue.worst_first(risk).collect()
    ]
    assert got == PER_HOTEL


def test_portfolio_and_concentration(risk):
    total = one(revenue.portfolio_totals(risk))
    assert (total.hotels, total.bookings) == (10, 250)
    assert (total.booked_revenue, total.lost_revenue) == (402584, 56558)
    assert total.lost_pct == Decimal("14.0")
    top = one(revenue.loss_concentration(risk, 3))
    assert (top.top_lost_revenue, top.top_bookings) == (45311, 87)
    assert (top.share_of_loss_pct, top.share_of_bookings_pct) == (Decimal("80.1"), Decimal("34.8"))


def test_correlation_and_rankings(risk):
    r = one(revenue.rating_correlation(risk))
    assert r.hotels == 10
    assert round(float(r.r), 3) == -0.841
    rank = one(revenue.rank_disagreement(risk))
    assert rank.worst_by_money == "Hampton by Hilton London Waterloo"
    assert (rank.worst_money_lost, rank.worst_rate_lost) == (22563, 3125)
    assert rank.worst_by_rate == "The Montana"
    assert rank.same_hotel is False


def test_correlation_without_variance_is_null(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "avg_rating double, cancel_rate_pct double")
    assert one(revenue.rating_correlation(flat)).r is None


def test_identity_reconciliation_and_spread(risk, tables):
    assert revenue.identity_violations(risk).count() == 0
    row = one(revenue.reconcile(risk, tables["Booking"], tables["Invoice"]))
    assert (row.report_booked, row.report_lost) == (402584, 56558)
    assert (row.booked_difference, row.lost_difference) == (0, 0)
    spread = one(revenue.per_hotel_spread(tables["Booking"], "HotelHotelID"))
    assert (spread.hotels, spread.min_rows, spread.max_rows) == (10, 18, 31)
    reviews = one(revenue.per_hotel_spread(tables["Feedback"], "HotelHotelID"))
    assert (reviews.hotels, reviews.min_rows) == (10, 8)


def test_a_booking_without_a_flag_breaks_the_identity(spark):
    facts = spark.createDataFrame(
        [(1, 1, 100), (1, 0, 50), (1, None, 7)], "hotel_id int, cancelled int, amount bigint"
    )
    row = one(revenue.identity_violations(revenue.measures(facts, "hotel_id")))
    assert row.unexplained == 7


def test_underbilling(tables):
    row = one(billing.underbilling(tables["Invoice"], tables["Booking"], tables["Room"]))
    assert (row.invoices, row.multi_room_invoices, row.affected_invoices) == (250, 48, 48)
    assert (row.correct_total, row.naive_total, row.underbilled) == (402584, 332336, 70248)


def test_multi_room_invoices(tables):
    several = billing.multi_room_invoices(tables["Invoice"], tables["Booking"], tables["Room"])
    assert several.count() == 48
    top = billing.largest(several, "Amount", "InvoiceID", 5).collect()
    assert [r.Amount for r in top] == sorted((r.Amount for r in several.collect()), reverse=True)[:5]
    assert all(r.Amount == r.nights * r.nightly_total for r in top)
    assert all(r.if_only_one_room_were_billed < r.Amount for r in top)


def test_no_mismatch_and_shortest_stay(tables):
    args = tables["Invoice"], tables["Booking"], tables["Room"]
    assert billing.amount_mismatches(*args).count() == 0
    assert one(tables["Booking"].agg(F.min("Duration").alias("m"))).m == 1
    assert tables["Booking"].where("Duration <= 0").count() == 0


def test_unreviewed_bookings(tables):
    free = revenue.without_review(tables["Booking"], tables["Feedback"])
    assert free.count() == 98
    feedback = tables["Feedback"]
    reviewed = free.join(feedback, free.BookingID == feedback.BookingBookingID, "left_semi")
    assert reviewed.count() == 0


def _with_rows(tables, name, rows):
    table = tables[name]
    return table.unionByName(table.sparkSession.createDataFrame(rows, TABLES[name].schema))


def _amount(tables, booking):
    bookings = billing.with_nights(tables["Booking"])
    invoices = billing.with_amounts(tables["Invoice"], bookings, tables["Room"])
    return one(invoices.where(F.col("BookingBookingID") == booking)).Amount


def test_billing_cases(tables):
    assert _amount(tables, 1000001) == 1800
    more = dict(tables)
    more["Room"] = _with_rows(tables, "Room", [(101, "Studio", 250, 4001, 1000001)])
    assert _amount(more, 1000001) == 6300
    more["Booking"] = _with_rows(
        tables,
        "Booking",
        [
            (1009001, date(2024, 3, 1), date(2024, 3, 6), 0, None, 2, 0, 1001, 4001),
            (1009002, date(2024, 3, 1), date(2024, 3, 10), 0, None, 6, 0, 1001, 4001),
        ],
    )
    more["Invoice"] = _with_rows(
        tables,
        "Invoice",
        [
            (9001, 1009001, None, 0, date(2024, 3, 6), "10:00"),
            (9002, 1009002, None, 0, date(2024, 3, 10), "10:00"),
        ],
    )
    more["Room"] = _with_rows(
        tables,
        "Room",
        [(9101 + i, "Single", p, 4001, 1009002) for i, p in enumerate((100, 250, 75))],
    )
    assert _amount(more, 1009001) == 0
    assert _amount(more, 1009002) == 3825
