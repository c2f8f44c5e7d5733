"""Exact dedup against a loop, on odd rows and with colliding hashes."""

import hashlib
import re

import pytest
from llm_tables import documents
from pyspark.sql import functions as F

from stayspark.llm import dedup, joins

ROWS = [
    (5, "a b"), (3, "a\t\nb"), (9, "a  b"), (4, "a b "), (7, None), (2, ""), (8, ""), (6, "é"), (1, "unique"),
    (3, "a b"), (None, "a b"), (None, "only"), (11, "a b"), (12, " "), (13, "  "), (14, "x " * 40_000),
    (15, "x  " * 40_000), (16, "twin"), (16, "twin"), (17, "twin"),
]
WEAK = [dedup.hash128, lambda sha: F.substring(sha, 1, 1), lambda sha: F.substring(sha, 1, 0)]


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def expected(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(norm(text), []).append(key)
    out = []
    for key, text in rows:
        group = groups[norm(text)]
        keep = min((k for k in group if k is not None), default=None)
        out.append((key, keep, len(group), key == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [200_000, 0])
@pytest.mark.parametrize("content_hash", WEAK)
def test_marks_equal_the_loop(spark, monkeypatch, content_hash, bound):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    docs = documents(spark, ROWS).repartition(3)
    got = dedup.mark_copies(docs, content_hash).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


@pytest.mark.parametrize("content_hash", WEAK)
def test_one_row_of_each_group_stays_unchanged(spark, content_hash):
    docs = documents(spark, ROWS)
    left = dedup.drop_copies(docs, content_hash)
    assert left.columns == docs.columns
    rows = left.collect()
    want = {(norm(t), keep) for (k, t), (_, keep, *_) in zip(sorted(ROWS, key=str), expected(ROWS), strict=True)}
    firsts = {}
    for key, text in ROWS:
        firsts.setdefault(norm(text), []).append(key)
    want = {(t, min((k for k in ks if k is not None), default=None)) for t, ks in firsts.items()}
    assert {(norm(r.text), r.doc_id) for r in rows} == want and len(rows) == len(want)
    assert {r.text for r in rows} <= {t for _, t in ROWS} and {r.key for r in rows} == {"clash"}


def test_hot_group_and_no_rows(spark):
    rows = [(i, "same") for i in range(400, 0, -1)] + [(i, f"text {i}") for i in range(401, 800)]
    assert sorted(r.doc_id for r in dedup.drop_copies(documents(spark, rows)).collect()) == [1, *range(401, 800)]
    none = documents(spark, [])
    assert dedup.mark_copies(none).collect() == [] and dedup.drop_copies(none).collect() == []


def test_main_path_has_no_python(spark):
    plan = dedup.drop_copies(documents(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
