"""Determinism, scale-out and storage of the generated tables."""

import pytest
from pyspark.sql import functions as F

from stayspark.model import TABLES, children_of, table_spec
from stayspark.operators import quality
from stayspark.operators.lookup import fingerprint
from stayspark.plans import build, revenue
from stayspark.sources import generator, tables as stored


def prints(frames):
    return {name: tuple(fingerprint(t).first()) for name, t in frames.items()}


def test_two_builds_are_equal_whatever_the_partitioning(spark, tables):
    rows = generator.with_hashes(generator.row_numbers(spark).repartition(7))
    again = generator.feedback(rows).unionByName(stored.sample_table(spark, "Feedback"))
    assert tuple(fingerprint(again).first()) == tuple(fingerprint(tables["Feedback"]).first())
    assert prints(build.derived(stored.all_tables(spark))) == prints(tables)


def test_risk_does_not_depend_on_shuffle_partitions(spark, tables):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            risk = revenue.hotel_revenue_at_risk(
                tables["Hotel"], tables["Booking"], tables["Invoice"], tables["Feedback"]
            )
            seen.add(tuple(fingerprint(risk).first()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1


def python_hash(n, factors):
    product = 1
    for multiplier, offset, prime in factors:
        product *= (n * multiplier + offset) % prime
    return product % generator.HASH_MODULUS


def test_hashes_are_exact_for_any_row_number(spark):
    numbers = [1, 2, 240, 10**6, 3_400_000_000, 10**12, 9 * 10**18]
    frame = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    for r in generator.with_hashes(frame).collect():
        assert (r.h, r.h2) == tuple(python_hash(r.n, f) for f in generator.HASH_FACTORS.values())


def test_hash_bounds(spark):
    row = generator.hash_bounds(generator.row_numbers(spark, 100_000)).first()
    assert row.row_count == 100_000
    assert 0 <= row.h_min < row.h_max < generator.HASH_MODULUS
    assert 0 <= row.h2_min < row.h2_max < generator.HASH_MODULUS


@pytest.mark.parametrize("size,bounds", [
    (0, {"customer_count": 10}), (17, {"customer_count": 27}), (10_000, {}), (10_001, {"second_room_base": 10**9}),
])
def test_rules_hold_at_other_sizes(spark, size, bounds):
    frames = build.derived(stored.all_tables(spark, size, **bounds))
    assert quality.violations(frames, TABLES).count() == 0
    assert frames["Booking"].count() == 10 + size


def test_a_larger_build_holds_the_smaller(spark):
    bounds = {"second_room_base": 10**9}
    small, large = (stored.all_tables(spark, n, **bounds) for n in (10_000, 10_001))
    for name in TABLES:
        assert small[name].exceptAll(large[name]).count() == 0
        assert large[name].count() - small[name].count() in (0, 1, 2)


def test_overlapping_rooms_and_missing_customers_raise(spark):
    with pytest.raises(ValueError):
        stored.all_tables(spark, 10_001)
    with pytest.raises(ValueError):
        stored.all_tables(spark, 239)


def test_stored_tables(spark, tables, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    written = build.build(spark, source)
    assert prints(written) == prints(tables)
    assert quality.schema_drift(spark, written, TABLES).count() == 0
    build.build(spark, source)  # replaces what is there
    assert prints(build.recompute(spark, source, target)) == prints(tables)
    with pytest.raises(ValueError):
        build.recompute(spark, source, source + "/")
    with pytest.raises(ValueError):
        stored.read_table(spark, source, "Customer; DROP TABLE Hotel")


def test_scan_prunes_and_pushes(spark, tmp_path):
    folder = str(tmp_path / "t")
    stored.write_tables({"Booking": stored.all_tables(spark)["Booking"]}, folder)
    frame = stored.read_table(spark, folder, "Booking").where("BookingID = 1000001").select("Meal")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(BookingID,1000001)" in plan
    assert "ReadSchema: struct<BookingID:bigint,Meal:int>" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, tables):
    stored.save_bucketed(tables, buckets=4, prefix="bucketed_")
    bookings, rooms, invoices = (
        spark.table(f"bucketed_{n}") for n in ("Booking", "Room", "Invoice")
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = build.with_amounts(invoices, bookings, rooms)
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert filled.agg(F.sum("Amount")).first()[0] == 402584
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


def test_declared_children():
    assert {(s.name, fk.columns[0]) for s, fk in children_of("Booking")} == {
        ("Room", "BookingBookingID"),
        ("Invoice", "BookingBookingID"),
        ("Feedback", "BookingBookingID"),
    }
    with pytest.raises(ValueError):
        table_spec("Guest")
