"""Change sets: hand-made cases, and random batches against a one-by-one loop."""

import random
from collections import Counter
from contextlib import contextmanager
from datetime import date

import pytest
from pyspark.sql import functions as F

from stayspark.model import BOOKING, CUSTOMER, FEEDBACK, HOTEL, INVOICE, ROOM, Check, TableSpec
from stayspark.operators import changes
from stayspark.operators.billing import with_nights
from stayspark.plans import edit
from stayspark.plans.create import create_rows
from stayspark.session import durable


def batch(spark, spec, rows):
    frame = spark.createDataFrame(rows, spec.schema)
    return frame.withColumn("seq", F.col(spec.primary_key[0]))


def insert(spark, tables, spec, rows):
    return changes.insert_rows(tables[spec.name], batch(spark, spec, rows), spec, "seq", tables)


def reasons(applied, key):
    return {r[key]: r.reason for r in applied.rejected.collect()}


# The published cases below use these keys and texts.
def booking(key, arrival, checkout, customer=1001, hotel=4001):
    return (key, arrival, checkout, 0, None, 2, 0, customer, hotel)


def test_booking_inserts(spark, tables):
    applied = insert(
        spark,
        tables,
        BOOKING,
        [
            booking(1009010, date(2022, 4, 10), date(2022, 4, 1)),
            booking(1009011, date(2022, 4, 10), date(2022, 4, 10)),
            booking(1009012, date(2022, 4, 10), date(2022, 4, 11)),
            booking(1009030, date(2024, 5, 1), date(2024, 5, 3), customer=999999),
            booking(1000001, date(2024, 5, 1), date(2024, 5, 3)),
            (1009031, None, date(2024, 5, 3), 0, None, 2, 0, 1001, 4001),
            (1009032, date(2024, 5, 1), date(2024, 5, 3), 7, None, 2, 0, 1001, 4001),
        ],
    )
    assert reasons(applied, "BookingID") == {
        1009010: "check Checkout_after_arrival",
        1009011: "check Checkout_after_arrival",
        1009030: "foreign_key CustomerCustomerID->Customer",
        1000001: "duplicate BookingID",
        1009031: "not_null Arrival_date",
        1009032: "check Cancellation_flag",
    }
    (row,) = with_nights(applied.accepted).collect()
    assert (row.BookingID, row.Duration) == (1009012, 1)
    assert applied.table.count() == 251


def test_invoice_and_review_cardinality(spark, tables):
    more = dict(tables)
    more["Booking"] = durable(
        insert(
            spark, tables, BOOKING, [booking(1009020, date(2024, 5, 1), date(2024, 5, 3))]
        ).table
    )
    invoices = insert(
        spark,
        more,
        INVOICE,
        [
            (9020, 1009020, 0, 0, date(2024, 5, 3), "10:00"),
            (9091, 1000001, 999, 0, date(2019, 7, 19), "13:00"),
            (9099, 7777777, 100, 0, date(2024, 1, 1), "10:00"),
        ],
    )
    assert [r.InvoiceID for r in invoices.accepted.collect()] == [9020]
    assert reasons(invoices, "InvoiceID") == {
        9091: "duplicate BookingBookingID",
        9099: "foreign_key BookingBookingID->Booking",
    }
    reviews = insert(
        spark,
        more,
        FEEDBACK,
        [
            (9191, 1000001, "One more.", 5, 4001),
            (9192, None, "No name.", 3, 4001),
            (9193, None, "No name either.", 3, 4001),
            (9194, None, "Too good.", 6, 4001),
        ],
    )
    assert {r.FeedbackID for r in reviews.accepted.collect()} == {9192, 9193}
    assert reasons(reviews, "FeedbackID") == {
        9191: "duplicate BookingBookingID",
        9194: "check Rating_1_to_5",
    }


def test_review_insert_then_delete(spark, tables):
    free = (
        tables["Booking"]
        .join(
            tables["Feedback"].select(F.col("BookingBookingID").alias("BookingID")),
            "BookingID",
            "left_anti",
        )
        .orderBy("BookingID")
        .first()
    )
    row = (111, free.BookingID, "Fine.", 5, free.HotelHotelID)
    after = insert(spark, tables, FEEDBACK, [row]).table
    assert after.count() == 153
    key = spark.createDataFrame([(111,)], "FeedbackID bigint")
    assert changes.delete_rows(after, key, FEEDBACK, "FeedbackID", []).table.count() == 152


def test_arity_and_names(spark, tables):
    two = spark.createDataFrame([(1, "x", 1)], "HotelID bigint, Name string, seq bigint")
    with pytest.raises(ValueError):
        changes.insert_rows(tables["Hotel"], two, HOTEL, "seq")
    with pytest.raises(ValueError):
        HOTEL.column("No_such")
    frame = spark.createDataFrame([(1, 4001, "x")], "seq bigint, HotelID bigint, value string")
    with pytest.raises(ValueError):
        changes.update_rows(tables["Hotel"], frame, HOTEL, "HotelID", "Nope", "seq")


def test_types_must_be_the_tables(spark, tables):
    wrong = tables["Hotel"].limit(1).withColumn("HotelID", F.lit(1.5)).withColumn("seq", F.lit(1))
    with pytest.raises(ValueError):
        changes.insert_rows(tables["Hotel"], wrong, HOTEL, "seq")
    ask = spark.createDataFrame([(1, 1001, 5)], "seq bigint, CustomerID bigint, value bigint")
    with pytest.raises(ValueError):
        changes.update_rows(tables["Customer"], ask, CUSTOMER, "CustomerID", "Last_name", "seq")


def test_every_change_has_one_outcome(spark):
    frame = spark.createDataFrame([(1, 0, 1, 9), (2, 0, 2, 9)], "id int, grp int, low int, high int")
    asks = [(1, 1, 3), (2, 1, 4), (3, None, 5), (4, 99, 6), (5, 2, -1), (6, 2, 50), (7, 1, 20), (8, 99, -2)]
    ask = spark.createDataFrame(asks, "seq int, id int, value int")
    got = changes.update_rows(frame, ask, SHELF, "id", "low", "seq")
    outcomes = {r.seq: (r.outcome, r.reason) for r in got.outcomes.collect()}
    assert outcomes == {
        1: ("superseded", None), 2: ("accepted", None), 3: ("rejected", "not_null id"), 4: ("unknown key", None),
        5: ("rejected", "check low_positive"), 6: ("rejected", "check low_below_high"),
        7: ("rejected", "check low_below_high"), 8: ("rejected", "check low_positive"),
    }
    assert [r.seq for r in got.accepted.collect()] == [2] and got.outcomes.count() == len(asks)
    assert {r.seq for r in got.rejected.collect()} == {3, 5, 6, 7, 8}
    keys = spark.createDataFrame([(1,), (1,), (None,), (7,), (2,)], "id int")
    child = [(spark.createDataFrame([(2,)], "ref int"), "ref")]
    gone = changes.delete_rows(frame, keys, SHELF, "id", child).outcomes.collect()
    assert {(r.id, r.outcome, r.reason, r.requests) for r in gone} == {
        (1, "accepted", None, 2), (None, "rejected", "not_null id", 1), (7, "unknown key", None, 1),
        (2, "rejected", "referenced", 1),
    }


def test_a_chain_stores_one_result_a_round(spark, monkeypatch):
    """Each row is blocked by the one before it, unless that one is blocked itself."""
    stored = []
    monkeypatch.setattr(changes, "durable", lambda df: stored.append(1) or durable(df))
    rows = [(1 + i // 2, 1 + (i + 1) // 2, i) for i in range(30)]
    spec = TableSpec("t", ("a",), unique=(("b",),))
    chain = spark.createDataFrame(rows, "a bigint, b bigint, seq bigint")
    empty = spark.createDataFrame([], "a bigint, b bigint")
    got = changes.insert_rows(empty, chain, spec, "seq")
    assert {tuple(r) for r in got.accepted.collect()} == {r[:2] for r in rows[::2]}
    assert len(stored) <= 2 + 15 + 1
    assert {r.outcome for r in got.outcomes.collect()} == {"accepted", "rejected"}


def test_hostile_text_is_data(spark, tables):
    text = "Smith'); DROP TABLE Hotel;--"
    ask = spark.createDataFrame([(1, 1001, text)], "seq bigint, CustomerID bigint, value string")
    applied = changes.update_rows(
        tables["Customer"], ask, CUSTOMER, "CustomerID", "Last_name", "seq"
    )
    assert applied.table.where("CustomerID = 1001").first().Last_name == text
    assert applied.table.columns == tables["Customer"].columns
    assert applied.table.count() == 250


def test_update_holds_the_checks(spark, tables):
    ask = spark.createDataFrame(
        [
            (1, 1000001, date(2019, 6, 1)),
            (2, 1000002, date(2020, 6, 1)),
            (3, 1000002, date(2020, 1, 1)),
            (4, 5, date(2020, 1, 1)),
        ],
        "seq bigint, BookingID bigint, value date",
    )
    applied = changes.update_rows(
        tables["Booking"], ask, BOOKING, "BookingID", "Checkout_date", "seq"
    )
    assert {r.seq for r in applied.rejected.collect()} == {1, 3}
    now = {r.BookingID: r.Checkout_date for r in applied.table.collect()}
    assert now[1000001] == date(2019, 7, 19)
    assert now[1000002] == date(2020, 6, 1)
    assert len(now) == 250


def test_update_of_a_unique_column(spark, tables):
    def move(*rows):
        ask = spark.createDataFrame(list(rows), "seq bigint, InvoiceID bigint, value bigint")
        return changes.update_rows(
            tables["Invoice"], ask, INVOICE, "InvoiceID", "BookingBookingID", "seq", tables
        )

    # Taken by another invoice, unknown booking, its own booking again.
    applied = move((1, 2001, 1000002), (2, 2002, 42), (3, 2003, 1000003))
    assert {r.seq: r.reason.split()[0] for r in applied.rejected.collect()} == {
        1: "duplicate",
        2: "foreign_key",
    }
    assert applied.table.select("BookingBookingID").distinct().count() == 250


def test_primary_key_update_and_reference(spark, tables):
    ask = spark.createDataFrame(
        [(1, 4001, 5001), (2, 4002, 4003)], "seq bigint, HotelID bigint, value bigint"
    )
    children = [(tables[n], "HotelHotelID") for n in ("Booking", "Room", "Feedback")]
    kept = changes.update_rows(
        tables["Hotel"], ask, HOTEL, "HotelID", "HotelID", "seq", children=children
    )
    assert {r.reason for r in kept.rejected.collect()} == {"referenced"}
    none = [(child.limit(0), column) for child, column in children]
    free = changes.update_rows(
        tables["Hotel"], ask, HOTEL, "HotelID", "HotelID", "seq", children=none
    )
    with pytest.raises(ValueError):
        changes.update_rows(tables["Hotel"], ask, HOTEL, "HotelID", "HotelID", "seq")
    assert {r.seq: r.reason for r in free.rejected.collect()} == {2: "duplicate HotelID"}
    assert {r.HotelID for r in free.table.collect()} == {5001, *range(4002, 4011)}


def test_null_and_delete(spark, tables):
    keys = spark.createDataFrame([(1, 4001), (2, 4999)], "seq bigint, HotelID bigint")
    blank = changes.null_values(tables["Hotel"], keys, HOTEL, "HotelID", "Contact", "seq")
    assert blank.table.where("Contact IS NULL").count() == 1
    refused = changes.null_values(tables["Hotel"], keys, HOTEL, "HotelID", "Name", "seq")
    assert refused.rejected.count() == 2 and refused.table.where("Name IS NULL").count() == 0
    children = [(tables[n], "HotelHotelID") for n in ("Booking", "Room", "Feedback")]
    with pytest.raises(ValueError):
        changes.delete_rows(tables["Hotel"], keys.select("HotelID"), HOTEL, "HotelID", children[:2])
    gone = changes.delete_rows(tables["Hotel"], keys.select("HotelID"), HOTEL, "HotelID", children)
    assert gone.table.count() == 10
    assert [r.reason for r in gone.rejected.collect()] == ["referenced"]
    rooms = spark.createDataFrame([("Studio",)], "Room_type string")
    fewer = changes.delete_rows(tables["Room"], rooms, ROOM, "Room_type", [])
    assert fewer.table.count() == tables["Room"].where("Room_type <> 'Studio'").count()


def test_create_rows_from_text(spark, tables):
    raw = spark.createDataFrame(
        [
            (10, " 1000010 ", " nice ", "4", "4010"),  # already reviewed
            (20, None, "ok", "3", "4001"),
            (30, None, "bad number", "four", "4001"),
            (40, None, "out of range", "9", "4001"),
            (50, None, "too big", "99999999999", "4001"),
            (60, None, "fine", "5", "4002"),
        ],
        "seq bigint, BookingBookingID string, Feedback_text string, Rating string,"
        "HotelHotelID string",
    )
    made = create_rows(tables, "Feedback", raw, "seq")
    assert made.table.schema.simpleString() == tables["Feedback"].schema.simpleString()
    new = {r.FeedbackID: (r.Feedback_text, r.Rating) for r in made.created.collect()}
    # One past the greatest key, without gaps for the refused rows.
    assert new == {1241: ("ok", 3), 1242: ("fine", 5)}
    assert made.table.count() == 154
    assert {(r.seq, r.column_name) for r in made.unparsed.collect()} == {(30, "Rating"), (50, "Rating")}
    assert {r.seq: r.reason for r in made.refused.collect()} == {
        10: "duplicate BookingBookingID",
        40: "check Rating_1_to_5",
    }


def test_edits_as_text_equal_the_loop(spark):
    frame = spark.createDataFrame([(i, 0, i % 4, 9) for i in range(8)], "id int, grp int, low int, high int")
    rnd = random.Random(2)
    keys, values = [" 3", "5 ", "x", "77", None, "1_0"], ["4", " 5\t", "oops", "-1", "30", None]
    raw = [(s, rnd.choice(keys), rnd.choice(values)) for s in range(60)]
    made = edit.edit_rows(
        frame, spark.createDataFrame(raw, "seq int, key string, value string"), SHELF, "low", "int", "seq"
    )
    table, bad, want = {i: i % 4 for i in range(8)}, set(), {}
    typed = {" 3": 3, "5 ": 5, "77": 77, "1_0": 10, None: None, "4": 4, " 5\t": 5, "-1": -1, "30": 30}
    for seq, key, value in raw:
        if key == "x" or value == "oops":
            bad.add(seq)
            continue
        k, v = typed[key], typed[value]
        if k is None or v is None or v < 0 or (k in table and v >= 9):
            want[seq] = "rejected"
        elif k not in table:
            want[seq] = "unknown key"
        else:
            want = {s: "superseded" if w == ("accepted", k) else w for s, w in want.items()}
            want[seq], table[k] = ("accepted", k), v
    got = {r.seq: r.outcome for r in made.outcomes.collect()}
    # Of several edits of an unknown key, all are unknown.
    assert got == {s: w if isinstance(w, str) else w[0] for s, w in want.items()}
    assert {r.seq for r in made.unparsed.collect()} == bad
    assert {r.id: r.low for r in made.table.collect()} == table


# --- against a loop ---------------------------------------------------------------------------

TWO_KEYS = TableSpec("claim", ("a",), unique=(("b",), ("c", "d")))


def one_by_one(existing, rows):
    """The outcome of inserting row by row under TWO_KEYS."""
    table, accepted = list(existing), []
    for row in rows:
        a, b, c, d, _ = row
        clash = a is None or any(
            a == x[0]
            or (b is not None and b == x[1])
            or (c is not None and d is not None and (c, d) == (x[2], x[3]))
            for x in table
        )
        if not clash:
            table.append(row)
            accepted.append(row)
    return accepted


@pytest.mark.parametrize("seed", range(4))
def test_insert_with_several_keys_equals_the_loop(spark, seed):
    rnd = random.Random(seed)

    def value(top):
        return None if rnd.random() < 0.1 else rnd.randint(0, top)

    schema = "a bigint, b bigint, c bigint, d bigint, seq bigint"
    existing = [(100 + i, 100 + i, 100 + i, 0, i) for i in range(3)]
    # A third of the rows share one key.
    rows = [
        (1 if rnd.random() < 0.33 else value(103), value(103), value(4), value(4), i)
        for i in range(120)
    ]
    got = changes.insert_rows(
        spark.createDataFrame(existing, schema).drop("seq"),
        spark.createDataFrame(rows, schema),
        TWO_KEYS,
        "seq",
    )
    want = one_by_one(existing, rows)
    assert Counter(tuple(r) for r in got.accepted.collect()) == Counter(r[:4] for r in want)
    assert got.rejected.count() == len(rows) - len(want)


def test_a_loser_does_not_block_others(spark):
    schema = "a bigint, b bigint, seq bigint"
    spec = TableSpec("t", ("a",), unique=(("b",),))
    chain = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 2, 3), (2, 3, 4), (3, 3, 5)], schema)
    empty = spark.createDataFrame([], "a bigint, b bigint")
    got = changes.insert_rows(empty, chain, spec, "seq").accepted.collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 2), (3, 3)}


SHELF = TableSpec(
    "shelf",
    ("id",),
    not_null=("low",),
    checks=(
        Check("low_positive", "low >= 0", ("low",)),
        Check("low_below_high", "low < high", ("low", "high")),
    ),
)


@pytest.mark.parametrize("seed", range(3))
def test_updates_equal_the_loop(spark, seed):
    rnd = random.Random(seed)
    table = {i: [i, rnd.randint(0, 4), rnd.randint(0, 5), rnd.choice([None, 5, 9])] for i in range(30)}
    asks = [
        (s, rnd.choice([3, rnd.randint(0, 34)]), rnd.choice([None, rnd.randint(-2, 12)]))
        for s in range(60)
    ]
    frame = spark.createDataFrame([tuple(r) for r in table.values()], "id int, grp int, low int, high int")
    ask = spark.createDataFrame(asks, "seq int, id int, value int")
    got = changes.update_rows(frame, ask, SHELF, "id", "low", "seq")
    refused = set()
    for seq, key, value in asks:
        bad = value is None or value < 0
        if not bad and key in table and table[key][3] is not None:
            bad = not value < table[key][3]
        if bad:
            refused.add(seq)
        elif key in table:
            table[key][2] = value
    assert {tuple(r) for r in got.table.collect()} == {tuple(r) for r in table.values()}
    assert {r.seq for r in got.rejected.collect()} == refused


@pytest.mark.parametrize("seed", range(3))
def test_updates_by_another_column(spark, seed):
    """Group 0 holds a third of the rows; the last locally valid change of a group is the one
    tested, and any row that would fail refuses it."""
    rnd = random.Random(seed)
    table = [
        [i, 0 if i % 3 == 0 else rnd.randint(1, 9), rnd.randint(0, 4), rnd.choice([None, 5, 9])]
        for i in range(40)
    ]
    asks = [(s, rnd.randint(0, 11), rnd.choice([None, -1, rnd.randint(0, 8)])) for s in range(30)]
    frame = spark.createDataFrame([tuple(r) for r in table], "id int, grp int, low int, high int")
    ask = spark.createDataFrame(asks, "seq int, grp int, value int")
    got = changes.update_rows(frame, ask, SHELF, "grp", "low", "seq")
    refused = {s for s, _, v in asks if v is None or v < 0}
    last = {g: (s, v) for s, g, v in asks if s not in refused}
    for g, (s, v) in last.items():
        hit = [r for r in table if r[1] == g]
        if any(r[3] is not None and not v < r[3] for r in hit):
            refused.add(s)
        else:
            for r in hit:
                r[2] = v
    assert {tuple(r) for r in got.table.collect()} == {tuple(r) for r in table}
    assert {r.seq for r in got.rejected.collect()} == refused


def test_delete_by_column_refuses_whole_keys(spark):
    frame = spark.range(30).select("id", (F.col("id") % 4).alias("grp"))
    children = [(spark.createDataFrame([(5,), (None,)], "ref bigint"), "ref")]
    keys = spark.createDataFrame([(1,), (2,), (2,), (9,)], "grp bigint")
    got = changes.delete_rows(frame, keys, TableSpec("t", ("id",)), "grp", children)
    assert {r.id for r in got.table.collect()} == {i for i in range(30) if i % 4 != 2}
    assert [r.grp for r in got.rejected.collect()] == [1]


def test_a_long_chain_of_rows_takes_few_rounds(spark, monkeypatch):
    """Each row shares one key with the row before it and one with the row after it: every second one gets in."""
    spec = TableSpec("claim", ("a",), unique=(("b",),))
    n = 10_000
    # Rows 2i and 2i + 1 share a; rows 2i + 1 and 2i + 2 share b.
    batch = spark.range(n).selectExpr("id DIV 2 AS a", "(id + 1) DIV 2 AS b", "id AS at").repartition(4)
    written = []
    plain = changes.in_rounds

    @contextmanager
    def counted(session):
        with plain(session) as store:
            yield lambda df: written.append(1) or store(df)

    monkeypatch.setattr(changes, "in_rounds", counted)
    done = changes.insert_rows(batch.select("a", "b").limit(0), batch, spec, "at")
    assert sorted(r["at"] for r in done.outcomes.where("outcome = 'accepted'").collect()) == list(range(0, n, 2))
    assert len(written) <= 30
