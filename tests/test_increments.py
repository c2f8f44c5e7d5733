"""Sliced tables, recomputing what changed, risk states and differences of builds, against full recomputes."""

import datetime
import glob
import random
from collections import Counter

import pytest

from stayspark.operators import differences
from stayspark.operators.deltas import CHANGE, applied, delta_of, signed
from stayspark.plans import increments, revenue, risk_state
from stayspark.plans.build import derived
from stayspark.sources.slices import SLICE, Sliced, slice_numbers

BOOKING = "BookingID long, HotelHotelID long, Arrival_date date, Checkout_date date, Duration int, Cancellation int"
ROOM = "Room_number long, BookingBookingID long, Price long"
INVOICE = "InvoiceID long, BookingBookingID long, Amount long"
DAY = datetime.date(2024, 1, 1)


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def spoil(folder, kept):
    """Make every file of other slices unreadable."""
    spoiled = 0
    for path in glob.glob(f"{folder}/{SLICE}=*/*.parquet"):
        if not any(f"{SLICE}={s}/" in path for s in kept):
            with open(path, "wb") as file:
                file.write(b"no parquet")
            spoiled += 1
    return spoiled


@pytest.fixture
def sliced(spark, tmp_path):
    table = Sliced(str(tmp_path / "t"), "k", 10, spark.createDataFrame([], "k long, v string").schema)
    table.write(spark.createDataFrame([(k, f"v{k}") for k in (None, None, -25, -3, 0, 9, 10, 55, 55)], table.schema))
    return table


def test_slices_are_read_and_replaced_alone(spark, sliced):
    assert sliced.read(spark).count() == 9
    assert rows_of(sliced.read(spark, [1, 7])) == Counter([(10, "v10")])
    assert rows_of(sliced.read(spark, [None])) == Counter([(None, "vNone")] * 2)
    assert sliced.read(spark, []).count() == 0
    # Division goes towards zero: the slice of zero is the wider one.
    assert sliced.read(spark, [0]).count() == 3
    spoil(sliced.folder, (1, 5))
    new = spark.createDataFrame([(11, "new"), (12, "new")], sliced.schema)
    sliced.replace(new, [1, 5])
    assert rows_of(sliced.read(spark, [1, 5])) == Counter([(11, "new"), (12, "new")])


def test_slices_may_become_empty(spark, sliced):
    sliced.replace(sliced.read(spark, []), [None, 0, 5])
    assert rows_of(sliced.read(spark)) == Counter([(-25, "v-25"), (10, "v10")])
    sliced.replace(spark.createDataFrame([(None, "back")], sliced.schema), [None])
    assert sliced.read(spark, [None]).count() == 1


def test_empty_table(spark, tmp_path):
    table = Sliced(str(tmp_path / "none"), "k", 10, spark.createDataFrame([], "k long").schema)
    table.write(spark.createDataFrame([], table.schema))
    assert table.read(spark).count() == table.read(spark, [1]).count() == 0
    assert slice_numbers(table.read(spark), 10) == []


def random_state(rng, bookings=60):
    def booking(k):
        arrival = DAY + datetime.timedelta(rng.randrange(30))
        leaves = rng.choice([None, *(arrival + datetime.timedelta(n) for n in range(1, 9))])
        return (k, rng.choice([1, 1, 1, 2, 3, None]), arrival, leaves, None, rng.choice([0, 1, None]))

    def owner():
        return rng.choice([None, 999, *range(bookings)])

    return {
        "Booking": {k: booking(k) for k in range(bookings)},
        "Room": {k: (k, owner(), rng.choice([None, *range(50, 90)])) for k in range(bookings * 2)},
        "Invoice": {k: (k, k if rng.random() < 0.8 else owner(), None) for k in range(bookings)},
    }


def changed_state(rng, state, near):
    """Rows lost, new and changed; bookings only among ``near``."""
    fresh = random_state(rng)
    after = {name: dict(rows) for name, rows in state.items()}
    for name, rows in after.items():
        for k in sorted(rows):
            home = rows[k][0] if name == "Booking" else rows[k][1]
            if home in near and rng.random() < 0.5:
                del rows[k]
                if rng.random() < 0.7 and k in fresh[name]:
                    new = list(fresh[name][k])
                    if name != "Booking":
                        new[1] = rng.choice([*near, home])
                    rows[k] = tuple(new)
        for extra in range(3):
            k = 1000 + rng.randrange(50)
            row = list(fresh[name][extra])
            row[0] = k
            if name != "Booking":
                row[1] = rng.choice(near)
                rows[k] = tuple(row)
    return after


def frames(spark, state):
    schemas = {"Booking": BOOKING, "Room": ROOM, "Invoice": INVOICE}
    return {n: spark.createDataFrame(list(rows.values()), schemas[n]) for n, rows in state.items()}


def full(spark, state):
    return {name: table.cache() for name, table in derived(frames(spark, state)).items()}


def test_touched_rows_equal_a_full_recompute(spark, tmp_path):
    rng = random.Random(0)
    state = random_state(rng)
    before = full(spark, state)
    stored = increments.store(before, str(tmp_path), 10)
    for step in range(2):
        near = [20, 21, 22, 47] if step == 0 else [None, 3, 999]
        after = changed_state(rng, state, near)
        given = {n: delta_of(a, b) for (n, a), b in zip(
            frames(spark, state).items(), frames(spark, after).values(), strict=True
        )}
        deltas = increments.recompute_touched(spark, stored, given)
        was, now = full(spark, state), full(spark, after)
        for name, table in stored.items():
            assert rows_of(table.read(spark)) == rows_of(now[name]), (name, step)
            if name != "Room":
                want = delta_of(was[name], now[name]).select(*deltas[name].columns)
                assert rows_of(deltas[name]) == rows_of(want), (name, step)
        state = after
    # The same deltas once more change nothing.
    increments.recompute_touched(spark, stored, given)
    assert all(rows_of(t.read(spark)) == rows_of(now[n]) for n, t in stored.items())


def test_untouched_slices_are_not_read(spark, tmp_path):
    rng = random.Random(7)
    state = random_state(rng)
    stored = increments.store(full(spark, state), str(tmp_path), 10)
    after = {**state, "Room": {k: (k, b, 7) if b == 25 else (k, b, p) for k, b, p in state["Room"].values()}}
    after["Room"][5000] = (5000, 25, 100)
    delta = delta_of(frames(spark, state)["Room"], frames(spark, after)["Room"])
    spoiled = sum(spoil(t.folder, [2]) for t in stored.values())
    assert spoiled > 10
    increments.recompute_touched(spark, stored, {"Room": delta})
    now = full(spark, after)["Invoice"].where("BookingBookingID BETWEEN 20 AND 29")
    assert rows_of(stored["Invoice"].read(spark, [2])) == rows_of(now)


def test_nothing_to_do(spark, tmp_path):
    stored = increments.store(full(spark, random_state(random.Random(1))), str(tmp_path), 10)
    assert increments.recompute_touched(spark, stored, {}) == {}
    none = signed(stored["Room"].read(spark, []), 1)
    spoil(str(tmp_path / "Booking"), [])
    deltas = increments.recompute_touched(spark, stored, {"Room": none})
    assert all(delta.count() == 0 for delta in deltas.values())


def test_states_follow_deltas(spark, tables):
    """Two changes in turn to the published data; the figures are those counted anew."""
    hotels = tables["Hotel"].selectExpr("HotelID AS hotel_id", "Name AS hotel")

    def reviews(feedback):
        return feedback.selectExpr("HotelHotelID AS hotel_id", "Rating AS rating")

    b, i, f = tables["Booking"], tables["Invoice"], tables["Feedback"]
    state = risk_state.hotel_state(signed(revenue.booking_facts(b, i), 1), signed(reviews(f), 1))
    risk = risk_state.risk_of(hotels, state)
    assert rows_of(risk) == rows_of(revenue.hotel_revenue_at_risk(tables["Hotel"], b, i, f))
    summary = risk_state.summary_of(signed(risk, 1))
    steps = [
        # A hotel loses all bookings, another all flags; an invoice goes, some amounts are gone.
        (
            b.where("HotelHotelID <> 1").selectExpr(
                *[c if c != "Cancellation" else "IF(HotelHotelID = 2, NULL, Cancellation) AS Cancellation" for c in b.columns]
            ),
            i.where("InvoiceID <> 77").selectExpr(
                *[c if c != "Amount" else "IF(InvoiceID % 9 = 0, NULL, Amount) AS Amount" for c in i.columns]
            ),
            f.where("HotelHotelID <> 3"),
        ),
        # All comes back, and bookings change hotels.
        (
            b.selectExpr(*[
                c if c != "HotelHotelID" else "IF(BookingID < 40, CAST(4 AS BIGINT), HotelHotelID) AS HotelHotelID"
                for c in b.columns
            ]),
            i,
            f.selectExpr(*[c if c != "Rating" else "IF(HotelHotelID = 5, NULL, Rating) AS Rating" for c in f.columns]),
        ),
    ]
    for b2, i2, f2 in steps:
        facts = risk_state.facts_delta(b2, delta_of(b, b2), i2, delta_of(i, i2))
        delta = risk_state.hotel_state(facts, delta_of(reviews(f), reviews(f2))).cache()
        state = risk_state.merged(state, delta).cache()
        after = risk_state.risk_of(hotels, state).cache()
        want = revenue.hotel_revenue_at_risk(tables["Hotel"], b2, i2, f2).cache()
        assert rows_of(after) == rows_of(want)
        summary = risk_state.summaries_merged(
            summary, risk_state.summary_of(risk_state.changed_risk(risk, after, delta.select("hotel_id")))
        ).cache()
        assert rows_of(risk_state.totals_of(summary)) == rows_of(revenue.portfolio_totals(want))
        assert rows_of(risk_state.correlation_of(summary)) == rows_of(revenue.rating_correlation(want))
        b, i, f, risk = b2, i2, f2, after


def test_applied_takes_all_rows_of_a_key(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    delta = spark.createDataFrame([(1, "a", -1), (1, "b", -1), (1, "z", 1), (3, "n", 1)], f"k long, v string, {CHANGE} int")
    assert rows_of(applied(rows, delta, "k")) == Counter([(1, "z"), (2, "c"), (3, "n")])


def loop_differences(first, second):
    keys = {r[0] for r in first + second}
    found = set()
    for k in keys:
        a, b = (Counter(r for r in rows if r[0] == k) for rows in (first, second))
        if a != b:
            change = "lost" if not b else "new" if not a else "changed"
            found.add((k, change, sum(a.values()), sum(b.values())))
    return found


def test_differences_equal_the_loop(spark, tmp_path):
    rng = random.Random(0)
    keys = [None, -(2**60), -700, -1, 0, 5, 2**40, 2**62, *range(1000, 1400)]
    first = [(rng.choice(keys), rng.choice([None, 0, 1]), rng.choice([None, "", "x"])) for _ in range(600)]
    second = list(first)
    for _ in range(6):
        at = rng.randrange(len(second))
        second[at] = rng.choice([(second[at][0], 2, None), (rng.choice(keys), *second[at][1:]), second[at - 1]])
    # A value that moves to another column, and a row of several alike that is lost.
    second += [(1500, 7, None), (1501, 0, "x")]
    first += [(1500, None, "7"), (1501, 0, "x"), (1501, 0, "x")]
    builds = []
    for name, rows in (("a", first), ("b", second)):
        frame = spark.createDataFrame(rows, "k long, v int, w string")
        build = Sliced(str(tmp_path / name), "k", 16, frame.schema)
        build.write(frame)
        builds.append((build, differences.content_tree(frame, "k", 16).cache()))
    want = loop_differences(first, second)
    (one, one_tree), (two, two_tree) = builds
    whole = differences.differing_keys(one.read(spark), two.read(spark), "k")
    assert {tuple(r) for r in whole.collect()} == want
    ranges = {r[0] for r in differences.differing_ranges(one_tree, two_tree).collect()}
    assert ranges == {None if k is None else int(k / 16) if abs(k) < 2**50 else k // 16 for k, *_ in want}
    names = ["__HIVE_DEFAULT_PARTITION__" if r is None else r for r in ranges]
    assert spoil(one.folder, names) > 5 < spoil(two.folder, names)
    found = differences.compare(spark, one, two, one_tree, two_tree)
    assert {tuple(r) for r in found.collect()} == want


def test_equal_builds_have_no_difference(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"{k}") for k in range(100)], "k long, v string")
    trees = [differences.content_tree(f, "k", 8) for f in (frame, frame.repartition(3))]
    assert differences.differing_ranges(*trees).count() == 0
    empty = differences.content_tree(frame.where("false"), "k", 8)
    assert differences.differing_ranges(empty, empty).count() == 0
    assert differences.differing_ranges(trees[0], empty).count() == 13
    table = Sliced(str(tmp_path / "x"), "k", 8, frame.schema)
    with pytest.raises(ValueError):
        differences.compare(spark, table, Sliced(table.folder, "k", 9, table.schema), *trees)
