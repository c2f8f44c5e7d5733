"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from llm_tables import FOLDER, documents, load
from pyspark.sql import functions as F

from stayspark.llm import components, joins, queries, simhash


def plain_print(text, shingle=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    runs = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or [words][: len(words)]
    hashes = [xxhash.xxh64_intdigest(" ".join(run), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """Smallest id reachable, by flooding over all pairs."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    group = list(range(len(ids)))
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    while True:
        new = [min(group[j] for j in np.flatnonzero(close[i])) for i in range(len(ids))]
        if new == group:
            return {key: ids[g] for key, g in zip(ids, group, strict=True)}
        group = new


def test_whole_table_equals_brute_force(spark):
    prints = {k: plain_print(t) for k, t in load("SELECT doc_id, text FROM documents")}
    group = plain_components(prints)
    got = queries.QUERIES["op9_simhash"](spark, FOLDER).collect()
    assert {tuple(r) for r in got} == {(k, f"{p:016x}", group[k]) for k, p in prints.items()}
    assert len(got) == len(prints)


ODD = [
    (1, "One two three four"), (2, "one  TWO\tthree\nfour"), (3, None), (4, ""), (5, " \n"), (6, "word"), (7, "two words"),
    (8, "É Ä İ ß"), (9, "é ä i̇ ß"), (10, "a b c " * 20_000), (11, "a b c"), (11, "other words stand here"),
    (12, "one two three four"), (12, "one two three four"), (13, "a b c\x1cd e"),
]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_odd_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    got = simhash.near_copies(documents(spark, ODD)).collect()
    assert sorted((r.doc_id, r.print % 2**64) for r in got) == sorted((k, plain_print(t)) for k, t in ODD)
    component = {(r.doc_id, r.print): r.component_id for r in got}
    assert {c for (k, _), c in component.items() if k in (1, 2, 12)} == {1}
    assert {c for (k, _), c in component.items() if k in (3, 4, 5)} == {3}
    left = sorted(r.doc_id for r in simhash.drop_near_copies(documents(spark, ODD)).collect())
    assert left == [1, 3, 6, 7, 8, 9, 10, 11, 11, 13]


def test_no_rows_and_no_ids(spark):
    assert simhash.near_copies(documents(spark, [])).collect() == []
    assert simhash.drop_near_copies(documents(spark, [])).collect() == []
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (9, "a b c")]
    got = simhash.drop_near_copies(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 4]


def clustered(rng, size):
    """Prints of which many lie a few bits from others, some in long chains and dense balls."""
    centres = rng.integers(0, 2**64, size // 4, dtype=np.uint64)
    near = [c ^ np.uint64(1 << int(b)) for c in centres for b in rng.integers(0, 64, 2)]
    ball = [centres[0] ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(20) for b in range(a)]
    chain = [np.uint64(((1 << (2 * i)) - 1) ^ int(centres[1])) for i in range(32)]
    return np.unique(np.array([*centres, *near, *ball, *chain], np.uint64))


@pytest.mark.parametrize("shard,limit", [(100, 4_000_000), (100, 60), (10**6, 4_000_000)])
def test_links_connect_what_brute_force_does(spark, monkeypatch, shard, limit):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)
    monkeypatch.setattr(simhash, "DIRECT", 32)
    prints = clustered(np.random.default_rng(1), 1200)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    links = simhash.links(frame, len(prints))
    assert links.count() <= 20 * len(prints)
    found = {r.node: r.root for r in components.components(links).collect()}
    want = plain_components({int(p): p for p in prints})
    groups = {}
    for p in prints.view(np.int64).tolist():
        groups.setdefault(found.get(p, p), set()).add(p % 2**64)
    expected = {}
    for p, root in want.items():
        expected.setdefault(root, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(i, i) for i in (3, 99)] + [(60, 50 + i) for i in range(10)]
    frame = spark.createDataFrame([*chain, (None, 3), *chain], "x long, y long")
    found = {r.node: r.root for r in components.components(frame).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 50 for i in range(51, 61) if i != 50}


@pytest.mark.parametrize("window,shingle", [(1, 3), (7, 3), (40, 1), (10**6, 5), (3, 2)])
def test_windows_give_all_shingles(monkeypatch, window, shingle):
    monkeypatch.setattr(simhash, "WINDOW_BYTES", window)
    for text in ["", " ", "one", "one two", " a  b\tC d\n\n e f g ", "aaa " * 50, "a" * 90 + " b c"]:
        words = text.lower().split()
        runs = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or [words][: len(words)]
        want = [xxhash.xxh64_digest(" ".join(r), 42) for r in runs]
        assert [d for block in simhash._digests(text.encode(), shingle) for d in block] == want


@pytest.mark.parametrize("window", [1, 2, 7])
def test_windows_of_fewer_words_than_a_shingle(monkeypatch, window):
    test_windows_give_all_shingles(monkeypatch, window, 5)
    test_windows_give_all_shingles(monkeypatch, window, 4)


def test_largest_task_of_a_star_reads_a_row_per_part(spark):
    links = spark.range(50_000).selectExpr("0L AS a", "id + 1 AS b").repartition(40)
    folded = components._least(links.union(links.select("b", "a")))
    assert folded.where("a = 0").first().m == 1 and folded.count() == 50_001
    # What meets at the centre: its parts, not its links or the tasks that hold them.
    by_part = links.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(components.PARTS))).count()
    assert by_part.count() == components.PARTS
    assert by_part.agg(F.max("count")).first()[0] < 2 * 50_000 / components.PARTS


X = "one two three four five six"


@pytest.mark.parametrize("shared", [True, False])
def test_rows_that_share_an_id_are_told_apart(spark, shared):
    rows = [(3, X), (7, X.replace(" ", "  ")), (8, X), (8, X), (None, X), (3, "other words on the smallest id")]
    rows += [(7, "something else that nobody has said")] if shared else []
    docs = documents(spark, rows).withColumn("_near_print0", F.lit(1)).withColumn("_near_id", F.lit(2))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = [(3, X), (3, "other words on the smallest id"), (None, X)] + rows[6:]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
