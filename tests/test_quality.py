"""Rule reports over clean and broken tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stayspark.model import BOOKING, FEEDBACK, INVOICE, TABLES, Check, ForeignKey, TableSpec
from stayspark.operators import quality


def report(df):
    return {(r.table_name, r.kind, r.rule, r.key): r.row_count for r in df.collect()}


def with_rows(tables, name, rows):
    extra = tables[name].sparkSession.createDataFrame(rows, TABLES[name].schema)
    return {**tables, name: tables[name].unionByName(extra)}


def test_thirty_one_constraints():
    specs = TABLES.values()
    assert len(specs) == 6
    assert sum(len(s.not_null) for s in specs) == 10
    assert sum(len(s.checks) for s in specs) == 6
    assert sum(len(s.unique) for s in specs) == 2
    assert sum(len(s.foreign_keys) for s in specs) == 7


def test_the_data_set_is_clean(tables):
    assert quality.violations(tables, TABLES).count() == 0


def test_every_kind_of_violation_is_reported(tables):
    broken = with_rows(
        tables,
        "Booking",
        [
            (1000001, date(2024, 1, 2), date(2024, 1, 1), 3, None, 1, None, 1001, 4999),
            (2000000, None, date(2024, 1, 1), 0, None, 1, 0, None, 4001),
            (None, date(2024, 1, 1), date(2024, 1, 2), 0, None, 1, 0, 1001, 4001),
        ],
    )
    broken = with_rows(
        broken,
        "Feedback",
        [(9000, 1000001, "again", 0, 4001), (9001, None, "a", 3, 4001), (9002, None, "b", 3, 4001)],
    )
    assert report(quality.violations(broken, TABLES)) == {
        ("Booking", "primary_key", "BookingID", "1000001"): 2,
        ("Booking", "primary_key", "BookingID", "NULL"): 1,
        ("Booking", "check", "Checkout_after_arrival", "1000001"): 1,
        ("Booking", "check", "Cancellation_flag", "1000001"): 1,
        ("Booking", "not_null", "Arrival_date", "2000000"): 1,
        ("Booking", "not_null", "CustomerCustomerID", "2000000"): 1,
        ("Booking", "foreign_key", "HotelHotelID->Hotel", "4999"): 1,
        ("Feedback", "check", "Rating_1_to_5", "9000"): 1,
        ("Feedback", "unique", "BookingBookingID", "1000001"): 2,
    }


def test_one_invoice_per_booking(tables):
    twice = with_rows(tables, "Invoice", [(9091, 1000001, 999, 0, date(2019, 7, 19), "13:00")])
    found = report(quality.unique_violations(twice["Invoice"], INVOICE))
    assert found == {("Invoice", "unique", "BookingBookingID", "1000001"): 2}


def test_orphan_rows_with_a_hot_key(spark):
    child = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 99).otherwise(F.col("id") % 5).alias("ref"))
    parent = spark.createDataFrame([(i,) for i in range(5)], "pid bigint")
    fk = ForeignKey(("ref",), "p", ("pid",))
    spec = TableSpec("c", ("id",), foreign_keys=(fk,))
    found = quality.foreign_key_violations({"c": child, "p": parent}, spec)
    assert report(found) == {("c", "foreign_key", "ref->p", "99"): 100}
    assert quality.orphan_rows(child, fk, parent).count() == 100


def test_null_passes_a_check(spark):
    frame = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id int, v int")
    spec = TableSpec("t", ("id",), checks=(Check("positive", "v >= 0", ("v",)),))
    assert report(quality.row_violations(frame, spec)) == {("t", "check", "positive", "3"): 1}


def test_schema_drift(spark, tables):
    assert quality.schema_drift(spark, tables, TABLES).count() == 0
    bent = {n: t for n, t in tables.items() if n != "Room"}
    bent["Hotel"] = tables["Hotel"].drop("Parking_space").withColumn("Stars", F.lit(1))
    bent["Extra"] = spark.range(1)
    drift = quality.schema_drift(spark, bent, TABLES).collect()
    assert {r.table_name for r in drift} == {"Hotel", "Room", "Extra"}
    (hotel,) = [r for r in drift if r.table_name == "Hotel"]
    assert (hotel.declared, hotel.found) == ("Parking_space int", "Stars int")


def test_column_kinds_are_known():
    kinds = {k for s in TABLES.values() for k in s.kinds.values()}
    assert kinds == {"int", "str", "bool", "date"}
    assert BOOKING.kinds["Cancellation"] == "bool" and FEEDBACK.kinds["Rating"] == "int"


def _report(frame):
    return sorted(map(tuple, frame.select("table_name", "kind", "rule", "key", "row_count").collect()))


@pytest.mark.parametrize(
    "child,parent",
    [
        ("decimal(10,2)", "bigint"), ("bigint", "decimal(10,2)"), ("int", "bigint"), ("string", "int"), ("int", "string"),
        ("double", "int"), ("date", "timestamp"), ("decimal(12,4)", "decimal(8,1)"), ("string", "string"),
    ],
)
def test_keys_of_different_types_are_compared_as_in_a_join(spark, child, parent):
    dates = {"date", "timestamp"}
    values = ["DATE'2020-01-0{}'", "{}"][not {child, parent} & dates]
    cell = lambda n, kind: f"CAST({values.format(n)} AS {kind})"
    kids = spark.sql(
        " UNION ALL ".join(f"SELECT {i}L AS id, {cell(n, child)} AS p" for i, n in enumerate([1, 2, 2, 3, 3]))
        + f" UNION ALL SELECT 9L, CAST(NULL AS {child})"
    )
    homes = spark.sql(" UNION ALL ".join(f"SELECT {cell(n, parent)} AS k" for n in (1, 2)))
    specs = {
        "kid": TableSpec("kid", ("id",), foreign_keys=(ForeignKey(("p",), "home", ("k",)),)),
        "home": TableSpec("home", ("k",)),
    }
    tables = {"kid": kids, "home": homes}
    want = quality.foreign_key_violations(tables, specs["kid"])
    assert _report(quality.violations(tables, specs)) == _report(want)
    assert [r.row_count for r in want.collect()] == [2]


def test_composite_keys_of_mixed_types(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1L, 'a', 1), (1L, 'a', 1), (1L, 'b', 2), (2L, NULL, 2), (NULL, 'a', 5), (3L, 'x', NULL) AS t(a, b, c)"
    )
    up = spark.sql("SELECT * FROM VALUES (1, 'a'), (1, 'b') AS t(x, y)")
    spec = TableSpec("t", ("a", "b"), unique=(("c",), ("b", "c")), foreign_keys=(ForeignKey(("a", "b"), "up", ("x", "y")),))
    tables = {"t": rows, "up": up}
    parts = [
        quality.primary_key_violations(rows, spec), quality.unique_violations(rows, spec),
        quality.foreign_key_violations(tables, spec),
    ]
    specs = {"t": spec, "up": TableSpec("up", ("x", "y"))}
    assert _report(quality.violations(tables, specs)) == sorted(x for p in parts for x in _report(p))


def test_keys_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(quality, "TASK_ROWS", 100)
    hot = F.when(F.col("id") < 400, 7).when(F.col("id") < 410, None).otherwise(F.col("id"))
    rows = spark.range(0, 2000, 1, 8).select(hot.alias("k"), F.lit("x").alias("v"))
    counts = quality._key_counts(rows, ["k"])
    held = counts.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 12 and max(r["count"] for r in held) < 250
    found = report(quality.primary_key_violations(rows, TableSpec("t", ("k",))))
    assert found == {("t", "primary_key", "k", "7"): 400, ("t", "primary_key", "k", "NULL"): 10}
