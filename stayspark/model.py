"""The six booking tables and their rules.

File tables enforce nothing, so the rules are data: ``operators.quality`` reports the rows that
break them and ``operators.changes`` keeps such rows from entering a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    DataType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{','.join(self.columns)}->{self.parent}"


@dataclass(frozen=True)
class Check:
    """A boolean SQL expression over one row.  A NULL result passes."""

    name: str
    predicate: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    name: str
    primary_key: tuple[str, ...]
    schema: StructType | None = None
    not_null: tuple[str, ...] = ()
    checks: tuple[Check, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames() if self.schema else []

    @property
    def required(self) -> tuple[str, ...]:
        """Columns that may not be NULL: the declared ones and the key."""
        return (*self.primary_key, *(c for c in self.not_null if c not in self.primary_key))

    @property
    def unique_rules(self) -> tuple[tuple[str, ...], ...]:
        return (self.primary_key, *self.unique)

    def column(self, name: str) -> str:
        if self.schema is not None and name not in self.columns:
            raise ValueError(f"unknown column {name!r} for table {self.name!r}")
        return name


_LONG, _INT, _TEXT, _DATE = LongType(), IntegerType(), StringType(), DateType()
_KIND = {_LONG: "int", _INT: "int", _TEXT: "str", _DATE: "date"}


def _table(
    name: str,
    columns: dict[str, DataType],
    flags: tuple[str, ...] = (),
    **rules,
) -> TableSpec:
    """The first column is the primary key; ``flags`` are 0/1 columns with a check each."""
    schema = StructType([StructField(c, t, True) for c, t in columns.items()])
    kinds = {c: "bool" if c in flags else _KIND[t] for c, t in columns.items()}
    checks = tuple(Check(f"{c}_flag", f"{c} IN (0, 1)", (c,)) for c in flags)
    return TableSpec(
        name=name,
        schema=schema,
        primary_key=(next(iter(columns)),),
        kinds=kinds,
        checks=checks + rules.pop("checks", ()),
        **rules,
    )


HOTEL = _table(
    "Hotel",
    {
        "HotelID": _LONG,
        "Name": _TEXT,
        "Contact": _TEXT,
        "Address": _TEXT,
        "Postal_code": _TEXT,
        "Parking_space": _INT,
    },
    flags=("Parking_space",),
    not_null=("Name",),
)

CUSTOMER = _table(
    "Customer",
    {
        "CustomerID": _LONG,
        "First_name": _TEXT,
        "Last_name": _TEXT,
        "Address": _TEXT,
        "Postal_code": _TEXT,
        "Contact_number": _TEXT,
        "Age": _INT,
    },
    not_null=("First_name", "Last_name"),
    checks=(Check("Age_not_negative", "Age >= 0", ("Age",)),),
)

BOOKING = _table(
    "Booking",
    {
        "BookingID": _LONG,
        "Arrival_date": _DATE,
        "Checkout_date": _DATE,
        "Cancellation": _INT,
        "Duration": _INT,
        "Number_of_guests": _INT,
        "Meal": _INT,
        "CustomerCustomerID": _LONG,
        "HotelHotelID": _LONG,
    },
    flags=("Cancellation", "Meal"),
    not_null=("Arrival_date", "Checkout_date", "CustomerCustomerID", "HotelHotelID"),
    checks=(
        Check(
            "Checkout_after_arrival",
            "Checkout_date > Arrival_date",
            ("Arrival_date", "Checkout_date"),
        ),
    ),
    foreign_keys=(
        ForeignKey(("CustomerCustomerID",), "Customer", ("CustomerID",)),
        ForeignKey(("HotelHotelID",), "Hotel", ("HotelID",)),
    ),
)

ROOM = _table(
    "Room",
    {
        "Room_number": _LONG,
        "Room_type": _TEXT,
        "Price": _LONG,
        "HotelHotelID": _LONG,
        "BookingBookingID": _LONG,
    },
    not_null=("HotelHotelID",),
    foreign_keys=(
        ForeignKey(("HotelHotelID",), "Hotel", ("HotelID",)),
        ForeignKey(("BookingBookingID",), "Booking", ("BookingID",)),
    ),
)

INVOICE = _table(
    "Invoice",
    {
        "InvoiceID": _LONG,
        "BookingBookingID": _LONG,
        "Amount": _LONG,
        "Discount": _LONG,
        "Date": _DATE,
        "Time": _TEXT,
    },
    not_null=("BookingBookingID",),
    unique=(("BookingBookingID",),),
    foreign_keys=(ForeignKey(("BookingBookingID",), "Booking", ("BookingID",)),),
)

FEEDBACK = _table(
    "Feedback",
    {
        "FeedbackID": _LONG,
        "BookingBookingID": _LONG,
        "Feedback_text": _TEXT,
        "Rating": _INT,
        "HotelHotelID": _LONG,
    },
    not_null=("HotelHotelID",),
    checks=(Check("Rating_1_to_5", "Rating BETWEEN 1 AND 5", ("Rating",)),),
    unique=(("BookingBookingID",),),
    foreign_keys=(
        ForeignKey(("BookingBookingID",), "Booking", ("BookingID",)),
        ForeignKey(("HotelHotelID",), "Hotel", ("HotelID",)),
    ),
)

# Parents before children.
TABLES: dict[str, TableSpec] = {
    spec.name: spec for spec in (HOTEL, CUSTOMER, BOOKING, ROOM, INVOICE, FEEDBACK)
}


def table_spec(name: str) -> TableSpec:
    try:
        return TABLES[name]
    except KeyError:
        raise ValueError(f"unknown table {name!r}") from None


def children_of(name: str) -> list[tuple[TableSpec, ForeignKey]]:
    """Every foreign key that points at the named table."""
    return [(s, fk) for s in TABLES.values() for fk in s.foreign_keys if fk.parent == name]
