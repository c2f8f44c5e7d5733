"""Deterministic sample data of any size.

Every value is arithmetic on a row number, so all tables of a row are computed side by side in
narrow projections: no random state, no join, no shuffle, and the same content for any
partitioning.  The small lists are literals that Catalyst folds into the plan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import clamp, int_div
from stayspark.model import TABLES

# Per hotel 4001..4010 the base price, cancellation percentage and base rating.
BASE_PRICE = (100, 110, 113, 225, 215, 250, 105, 112, 212, 260)
CANCEL_PCT = (24, 6, 30, 12, 24, 6, 12, 18, 12, 30)
RATING_BASE = (2, 5, 1, 4, 2, 5, 4, 3, 4, 1)

# Word lists.
FIRST_NAMES = (
    "Amelia", "Noah", "Priya", "Jonas", "Chloe", "Marcus", "Aisha", "Tobias", "Elena", "Rohan",
    "Freya", "Samuel", "Nadia", "Oliver", "Leila", "Hugo", "Sofia", "Callum", "Mira", "Declan",
)
LAST_NAMES = (
    "Hartley", "Okafor", "Lindqvist", "Ferreira", "Nakamura", "Brennan", "Kaur", "Moreau",
    "Vasquez", "Whitfield", "Adeyemi", "Sorensen", "Rahman", "Costa", "Delaney", "Novak", "Iyer",
    "Mbeki", "Larsen", "Quinn",
)
STREETS = ("Kingsway", "Beech Grove", "Carlisle Road", "Priory Lane")
ROOM_TYPES = ("Single", "Double", "Triple", "Studio")
REVIEWS = (
    "Would not stay here again.",
    "Below what we expected for the price.",
    "Adequate, nothing memorable either way.",
    "Good stay, we would come back.",
    "Excellent room and genuinely helpful staff.",
)

# The two hashes are products of two linear residues, (multiplier, offset, prime).
HASH_FACTORS = {
    "h": ((2654435761, 1013904223, 1000003), (40503, 12345, 999983)),
    "h2": ((1103515245, 12345, 1000033), (22695477, 1, 999979)),
}
HASH_MODULUS = 4294967291

# The first key of every generated table is one past these.
CUSTOMER_BASE, BOOKING_BASE, INVOICE_BASE, FEEDBACK_BASE = 1010, 1000010, 3000, 1000
ROOM_BASE, FIRST_CUSTOMER, FIRST_HOTEL, HAND_CUSTOMERS = 10000, 1001, 4001, 10
SECOND_ROOM_BASE = 20000
FIRST_ARRIVAL = date(2023, 1, 1)

DEFAULT_SIZE = 240


# Rows per task and output file.
SLICE = 5_000_000


def row_numbers(spark: SparkSession, size: int = DEFAULT_SIZE) -> DataFrame:
    slices = max(spark.sparkContext.defaultParallelism, -(-size // SLICE))
    return spark.range(1, size + 1, numPartitions=slices).withColumnRenamed("id", "n")


def with_hashes(rows: DataFrame) -> DataFrame:
    """Add ``h`` and ``h2`` to rows numbered by ``n``.

    Row number and multiplier are both reduced before they are multiplied, which leaves the
    residue as it is and keeps every product below 2^63 for any row number.
    """

    def residue(multiplier: int, offset: int, prime: int) -> Column:
        return ((F.col("n") % prime) * (multiplier % prime) + offset) % prime

    return rows.withColumns(
        {
            name: (residue(*first) * residue(*second)) % HASH_MODULUS
            for name, (first, second) in HASH_FACTORS.items()
        }
    )


def _digits(hash_name: str, divisor: int, modulus: int) -> Column:
    """One field's slice of a hash."""
    return int_div(F.col(hash_name), divisor) % modulus


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _per_hotel(values: tuple) -> Column:
    return _pick(values, F.col("h") % len(values))


def _hotel() -> Column:
    return F.lit(FIRST_HOTEL).cast("bigint") + F.col("h") % len(BASE_PRICE)


def _booking() -> Column:
    return F.col("n") + BOOKING_BASE


def _stay_start() -> Column:
    return _digits("h", 20000, 730)


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(FIRST_ARRIVAL), offset.cast("int"))


def _checkout() -> Column:
    return _day(_stay_start() + 1 + _digits("h", 1000, 14))


def _cancelled() -> Column:
    return (_digits("h", 10, 100) < _per_hotel(CANCEL_PCT)).cast("int")


def _rating() -> Column:
    return clamp(_per_hotel(RATING_BASE) - 1 + _digits("h", 17, 3), 1, 5).cast("int")


def _as_table(rows: DataFrame, name: str, **columns: Column) -> DataFrame:
    schema = TABLES[name].schema
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def customers(rows: DataFrame) -> DataFrame:
    house = 1 + _digits("h2", 7, 250)
    return _as_table(
        rows,
        "Customer",
        CustomerID=F.col("n") + CUSTOMER_BASE,
        First_name=_pick(FIRST_NAMES, _digits("h", 7, 20)),
        Last_name=_pick(LAST_NAMES, _digits("h2", 137, 20)),
        Address=F.concat_ws(" ", house.cast("string"), _pick(STREETS, _digits("h2", 13, 4))),
        Postal_code=F.format_string(
            "N%d %dAB", 1 + _digits("h", 3, 9), 1 + _digits("h", 19, 9)
        ),
        Contact_number=F.format_string("7%09d", _digits("h2", 11, 1000000000)),
        Age=18 + _digits("h", 23, 62),
    )


def bookings(rows: DataFrame, customer_count: int) -> DataFrame:
    """``customer_count`` customers, from the first one on, are there to book."""
    return _as_table(
        rows,
        "Booking",
        BookingID=_booking(),
        Arrival_date=_day(_stay_start()),
        Checkout_date=_checkout(),
        Cancellation=_cancelled(),
        Duration=F.lit(None),
        Number_of_guests=1 + _digits("h2", 3, 4),
        Meal=_digits("h2", 11, 2),
        CustomerCustomerID=FIRST_CUSTOMER + F.col("h2") % customer_count,
        HotelHotelID=_hotel(),
    )


def _rooms(rows: DataFrame, base: int, price_hash: str, type_hash: str) -> DataFrame:
    return _as_table(
        rows,
        "Room",
        Room_number=F.col("n") + base,
        Room_type=_pick(ROOM_TYPES, _digits(type_hash, 17, 4)),
        Price=_per_hotel(BASE_PRICE) - 20 + _digits(price_hash, 41, 41),
        HotelHotelID=_hotel(),
        BookingBookingID=_booking(),
    )


def primary_rooms(rows: DataFrame) -> DataFrame:
    return _rooms(rows, ROOM_BASE, "h", "h2")


def second_rooms(rows: DataFrame, base: int = SECOND_ROOM_BASE) -> DataFrame:
    """A second room for about one booking in five.

    The numbers start past ``base``, which must lie beyond the primary rooms' and does not follow from
    how many rows there are: a larger build holds every row of a smaller one.
    """
    return _rooms(rows.where(_digits("h2", 23, 5) == 0), base, "h2", "h")


def invoices(rows: DataFrame) -> DataFrame:
    return _as_table(
        rows,
        "Invoice",
        InvoiceID=F.col("n") + INVOICE_BASE,
        BookingBookingID=_booking(),
        Amount=F.lit(None),
        Discount=_digits("h", 31, 61),
        Date=_checkout(),
        Time=F.format_string("%02d:%02d", _digits("h2", 53, 24), _digits("h", 59, 60)),
    )


def feedback(rows: DataFrame) -> DataFrame:
    """Reviews for about 70 % of the stays that took place."""
    stayed = rows.where((_cancelled() == 0) & (_digits("h2", 29, 10) < 7))
    return _as_table(
        stayed,
        "Feedback",
        FeedbackID=F.col("n") + FEEDBACK_BASE,
        BookingBookingID=_booking(),
        Feedback_text=_pick(REVIEWS, _rating() - 1),
        Rating=_rating(),
        HotelHotelID=_hotel(),
    )


def hash_bounds(rows: DataFrame) -> DataFrame:
    """Smallest and largest hash: whole numbers below the modulus show that nothing overflowed."""
    return with_hashes(rows).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("h").alias("h_min"),
        F.max("h").alias("h_max"),
        F.min("h2").alias("h2_min"),
        F.max("h2").alias("h2_max"),
    )
