"""Every registered query against its SQL on the given files."""

import os

import pytest
from oracle import difference, duck

import __spark_entry__ as contract
from stayspark.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")

# The queries of the optional subpackage have their own tests.


@pytest.fixture(scope="module")
def db():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert difference(db, ORACLES[name], QUERIES[name](spark, FOLDER)) is None


def test_two_key_insert_equals_the_loop(spark, db):
    rows = db.execute(
        "SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events ORDER BY event_id"
    ).fetchall()
    users, seats, want = set(), set(), set()
    for user, seat in rows:
        if user not in users and seat not in seats:
            users.add(user)
            seats.add(seat)
            want.add((user, seat))
    got = QUERIES["apply_insert_two_keys"](spark, FOLDER).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() == 25
    assert frame.columns[:3] == ["hotel_id", "hotel", "bookings"]
