"""Ingest, look-ups, keys and the catalogue on small fixtures."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from stayspark.functions import parsing
from stayspark.functions.numbers import minor_units
from stayspark.operators import catalogue, ids, ingest, lookup
from stayspark.sources.sample import CATALOGUE

# --- parsing ----------------------------------------------------------------------------------

# Raw text and the value it stands for.  Only ASCII digits count; digits of other scripts
# are refused.
PARSED = {
    "int": {
        "5": 5, " 42 ": 42, "-7": -7, "+8": 8, "1_000": 1000, "1__0": None, "_1": None, "1.5": None, "": None, "x": None,
        "9223372036854775807": 9223372036854775807, "9223372036854775808": None, "٣": None, "1٣": None,
    },
    "bool": {"0": 0, " 1 ": 1, "TRUE": 1, "False": 0, "yes": None, "2": None, "": None, "01": None},
    "date": {
        "2022-04-09": datetime.date(2022, 4, 9), "2022-4-9": datetime.date(2022, 4, 9),
        " 2022-12-31 ": datetime.date(2022, 12, 31), "2022": None, "2022-13-01": None, "2022-02-30": None, "22-1-1": None,
        "2022-04-09 10:00": None, "2024-02-29": datetime.date(2024, 2, 29), "2023-02-29": None, "": None,
    },
    "str": {"  a b ": "a b", "": "", "\tx\n": "x", " y　": "y"},
}


@pytest.mark.parametrize("kind", sorted(PARSED))
def test_parse(spark, kind):
    frame = spark.createDataFrame([(r,) for r in PARSED[kind]], "raw string")
    got = frame.select("raw", parsing.parse(F.col("raw"), kind).alias("v")).collect()
    assert {r.raw: r.v for r in got} == PARSED[kind]


def test_unknown_kind():
    with pytest.raises(ValueError):
        parsing.parse(F.lit("x"), "float")


def test_ingest_splits_rows(spark):
    raw = spark.createDataFrame(
        [(1, "5", "true", "2022-4-9"), (2, "x", "maybe", "2022-4-9"), (3, None, "0", "2022-04-31")],
        "id int, guests string, meal string, day string",
    )
    done = ingest.typed_ingest(raw, {"guests": "int", "meal": "bool", "day": "date"}, "Booking", "id")
    assert [tuple(r) for r in done.clean.collect()] == [(1, 5, 1, datetime.date(2022, 4, 9))]
    rejects = {(r.id, r.column_name, r.raw, r.reason) for r in done.rejects.collect()}
    assert rejects == {
        (2, "guests", "x", "expected int"),
        (2, "meal", "maybe", "expected bool"),
        (3, "day", "2022-04-31", "expected date"),
    }


# --- keys -------------------------------------------------------------------------------------


def test_next_key(spark, tables):
    assert ids.next_key(tables["Feedback"], "FeedbackID").first().next_key == 1241
    assert ids.next_key(spark.createDataFrame([], "k bigint"), "k").first().next_key == 1


def test_positions_over_sparse_keys(spark):
    rnd = random.Random(3)
    keys = {-(2**63), 2**63 - 1, 0, -1, 1, 65535, 65536, 2**32, 2**48}
    keys |= {rnd.randint(-(2**63), 2**63 - 1) for _ in range(200)}
    keys |= {rnd.randint(0, 200_000) for _ in range(200)}
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.p for r in ids.with_positions(frame, "k", "p").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_batch_keys_follow_the_table(spark, tables):
    rows = spark.range(5).select((F.col("id") * 1_000_000).alias("seq"))
    got = ids.with_new_keys(rows, tables["Feedback"], "FeedbackID", "seq").collect()
    assert {r.seq: r.FeedbackID for r in got} == {i * 1_000_000: 1241 + i for i in range(5)}


def test_amounts_without_exact_cents_raise(spark):
    def cents(value):
        return spark.createDataFrame([(value,)], "x double").select(minor_units(F.col("x"))).first()[0]

    assert [cents(v) for v in (1.25, -0.01, None, 9e13)] == [125, -1, None, 9 * 10**15]
    for value in (float("nan"), float("inf"), -float("inf"), 1e15):
        with pytest.raises(Exception, match="no exact amount"):
            cents(value)


# --- look-ups ---------------------------------------------------------------------------------


def test_lookups(spark, tables):
    assert lookup.rows_where(tables["Room"], "Room_type", "Studio").count() > 1
    with pytest.raises(ValueError):
        lookup.rows_where(tables["Room"], "Nope", 1)
    with pytest.raises(ValueError):
        lookup.distinct_values(tables["Room"], "Nope")
    keys = spark.createDataFrame([("Studio",), ("Single",), ("Tent",), (None,)], "t string")
    got = lookup.rows_with_keys(tables["Room"], "Room_type", keys)
    assert got.count() == tables["Room"].where("Room_type IN ('Studio', 'Single')").count()
    typed = spark.createDataFrame([(" 4001 ",), ("04001",), ("9",), ("x",), ("99999999999999999999",)], "t string")
    found = lookup.known_keys(tables["Hotel"], "HotelID", typed, "t").collect()
    assert {r.key: r.found for r in found} == {
        "4001": True, "04001": False, "9": False, "x": False, "99999999999999999999": False,
    }
    asked = spark.createDataFrame([(1000001,), (7,)], "b bigint")
    answers = {r.BookingBookingID: (r.found, r.Amount) for r in lookup.invoices_for(asked, tables["Invoice"]).collect()}
    assert answers == {1000001: (True, 1800), 7: (False, None)}


def test_profile_and_fingerprint(spark):
    frame = spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (None, "b")], "x int, y string")
    got = {r.column_name: (r.row_count, r.null_count, r.distinct_count) for r in lookup.profile({"t": frame}).collect()}
    assert got == {"x": (4, 1, 2), "y": (4, 1, 2)}
    prints = {
        tuple(lookup.fingerprint(f).first())
        for f in (frame, frame.orderBy(F.desc("x")), frame.repartition(3))
    }
    assert len(prints) == 1
    assert tuple(lookup.fingerprint(frame.limit(3)).first()) not in prints
    assert tuple(lookup.fingerprint(frame.limit(0)).first()) == (0, 0)
    moved = spark.createDataFrame([("x", None), (None, "x"), ("x|", "y"), ("x", "|y")], "a string, b string")
    sums = {tuple(lookup.fingerprint(moved.where(F.xxhash64("a", "b", F.col("a").isNull()) == F.lit(h))).first())
            for (h,) in moved.select(F.xxhash64("a", "b", F.col("a").isNull())).collect()}
    assert len(sums) == 4
    assert [tuple(r) for r in lookup.same_content(frame, frame.repartition(3)).collect()] == [(4, True)]
    assert [tuple(r) for r in lookup.same_content(frame, frame.limit(3)).collect()] == [(4, False)]


# --- catalogue --------------------------------------------------------------------------------


def collection(spark, docs, first=1):
    rows = [(first + i, json.dumps(d)) for i, d in enumerate(docs)]
    return catalogue.collection(spark.createDataFrame(rows, "seq bigint, text string"), "text", "seq")


def test_catalogue_round_trip(spark):
    docs = collection(spark, CATALOGUE)
    assert catalogue.count(docs).first().documents == 3
    read = {tuple(r)[1:] for r in catalogue.project(docs).collect()}
    assert read == {tuple(d[f] for f in catalogue.HOTEL_FIELDS) for d in CATALOGUE}
    done = catalogue.delete_first(docs, spark.createDataFrame([("4010",), ("9",)], "k string"), "ID")
    assert done.deleted.count() == 1
    assert {r.ID for r in catalogue.project(done.remaining).collect()} == {"4002", "4005"}
    assert catalogue.clear(docs).count() == 0


def test_only_the_first_match_is_deleted(spark):
    docs = collection(spark, CATALOGUE)
    done = catalogue.delete_first(docs, spark.createDataFrame([("London",)], "k string"), "CITY")
    assert [r.seq for r in done.deleted.collect()] == [1]
    assert catalogue.count(done.remaining).first().documents == 2


@pytest.mark.parametrize("times", [0, 1, 2, 5, 50])
def test_each_request_deletes_one_document(spark, times):
    cities = ["hot"] * 20 + ["b", "hot", "b", "c", None, "b"] * 7
    docs = collection(spark, [{"ID": i, "CITY": c} for i, c in enumerate(cities)])
    asked = ["hot"] * times + ["b"] * (times // 2) + ["nowhere", None] * 2 + ["c"]
    done = catalogue.delete_in_turn(docs, spark.createDataFrame([(c,) for c in asked], "k string"), "CITY")
    left = list(enumerate(cities, 1))
    for key in asked:
        hit = next((d for d in left if key is not None and d[1] == key), None)
        if hit is not None:
            left.remove(hit)
    gone = {s for s, _ in enumerate(cities, 1)} - {d[0] for d in left}
    assert {r.seq for r in done.deleted.collect()} == gone
    assert {r.seq for r in done.remaining.collect()} == {d[0] for d in left}


def test_flexible_shapes(spark):
    odd = [{"ID": 7, "FACILITIES": ["pool", "bar"]}, {"NAME": {"x": 1}}, {"ID": "8", "FACILITIES": ["bar"]}]
    docs = catalogue.insert(collection(spark, CATALOGUE), collection(spark, odd, 10))
    read = {r.seq: (r.ID, r.CITY) for r in catalogue.project(docs).collect()}
    assert read[10] == ("7", None) and read[11] == (None, None) and read[1] == ("4002", "London")
    assert {r.seq for r in catalogue.find(docs, {"STAR": "4", "CITY": "London"}).collect()} == {1, 2}
    assert {r.seq for r in catalogue.with_item(docs, "FACILITIES", "pool").collect()} == {10}
    listed = sorted((r.seq, r.item) for r in catalogue.items(docs, "FACILITIES").collect())
    assert listed == [(10, "bar"), (10, "pool"), (12, "bar")]


def test_broken_json_is_null(spark):
    frame = spark.createDataFrame([(1, "{oops"), (2, '{"ID": "1"}')], "seq bigint, text string")
    docs = catalogue.collection(frame, "text", "seq")
    assert {r.seq: r.ID for r in catalogue.project(docs, ["ID"]).collect()} == {1: None, 2: "1"}


def test_rows_dealt_out_by_size(spark):
    """More rows go to more tasks, with the same content."""
    rows = spark.range(0, 80_000, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    sizes = [r["count"] for r in lookup.dealt_out(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 5_000
    assert lookup.same_content(rows, lookup.dealt_out(rows)).first().same
