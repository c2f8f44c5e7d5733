"""Prefix tries against a walk over all beginnings, and list ranking against plain sums."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stayspark.llm import list_rank, prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, place int, k0 int"


def hashed(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    """Turns of each conversation in order."""
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by.setdefault(conv, []).append(((turn is not None, turn or 0, hashed(role, text)), role, text))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h, trunk = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(trunk, [])[:h] + own[h:]
    return out


def expected(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = {}, {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        members = nodes[key]
        own = (len(members) - 1) * len(key[-1][1]) if key else 0
        leaves[key] = leaves.get(key, 0) or 1
        saved[key] = saved.get(key, 0) + own
        if key:
            up = key[:-1]
            leaves[up] = leaves.get(up, 0) + leaves[key]
            saved[up] = saved.get(up, 0) + saved[key]
            children[up] = children.get(up, 0) + 1
    out = []
    for key, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(key))))
        parent = min(nodes[key[:-1]]) if key else None
        out.append(
            (min(members), len(key), parent, len(members), children.get(key, 0), leaves[key], saved[key],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(4)


def trie(spark, rows):
    found = prefix_trie.trie_of_turns(frame(spark, rows)).drop("entered", "left")
    return sorted(map(tuple, found.collect()))


ODD = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "x"), (2, 0, "user", "hello"), (2, 1, "assistant", "y"), (3, 0, "user", "hello"),
    (4, None, None, None), (4, 0, "", ""), (5, 0, "", ""), (5, 1, None, ""), (None, 0, "user", "lost"), (-7, 0, "user", "hello"),
    (6, 0, "u", "ser"), (7, 0, "us", "er"), (8, 3, "user", "é🙂"), (8, 3, "user", "é🙂"), (8, 2, "user", "long " * 60_000),
    (100, 0, "user", "é🙂"), (101, 0, "user", "hello"), (1 << 62, 0, "user", "hello"),
]


def test_odd_rows(spark):
    assert trie(spark, ODD) == expected(plain(ODD))


def test_no_rows(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "lost")]) == []


@pytest.mark.parametrize("one_task", [4, 256])
def test_deep_wide_and_equal_conversations(spark, monkeypatch, one_task):
    monkeypatch.setattr(list_rank, "ONE_TASK", one_task)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rng = random.Random(one_task)
    rows = [(0, t, "user", f"deep {t}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]
    for c in range(100, 160):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for t in range(rng.randrange(1, 7))]
    assert trie(spark, rows) == expected(plain(rows))


def test_branches_of_a_trunk(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", f"{c} {t}") for c in [*range(-3, 3), *range(98, 130), 205] for t in range(rng.randrange(1, 8))]
    convs, placed = prefix_trie.branched(prefix_trie.placed_turns(frame(spark, rows)))
    found = prefix_trie.prefix_trie(convs, placed).drop("entered", "left")
    assert sorted(map(tuple, found.collect())) == expected(rebuilt(plain(rows)))


def test_tour_encloses_subtrees(spark):
    found = prefix_trie.trie_of_turns(frame(spark, ODD)).collect()
    arcs = sorted(a for r in found for a in (r.entered, r.left))
    assert arcs == list(range(2 * len(found)))
    for r in found:
        inside = [s for s in found if r.entered <= s.entered and s.left <= r.left]
        assert sum(s.n_children == 0 for s in inside) == r.n_leaves


def test_lists_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(list_rank, "ONE_TASK", 8)
    order = list(range(700))
    random.Random(1).shuffle(order)
    # Two lists, and one of a single element.
    starts = {0, 300, 699}
    rows = [((order[i],), None if i in starts else (order[i - 1],), i, 1) for i in range(700)]
    schema = "id struct<a:long>, pred struct<a:long>, v int, one int"
    found = list_rank.prefix_sums(spark.createDataFrame(rows, schema), ["v", "one"]).collect()
    want, sums = {}, (0, 0)
    for i in range(700):
        sums = (i, 1) if i in starts else (sums[0] + i, sums[1] + 1)
        want[order[i]] = sums
    assert {r.id.a: (r.v, r.one) for r in found} == want


def test_largest_task_of_a_hot_first_turn(spark):
    """All conversations are children of one node, and end at one: no window holds them all."""
    turns = spark.range(4000).selectExpr("id AS conv_id", "0 AS turn", "'u' AS role", "concat('t', id % 2000) AS text")
    found = prefix_trie.trie_of_turns(turns)
    root = found.where("depth = 0").first()
    assert (root.n_convs, root.n_children, root.n_leaves) == (4000, 2000, 2000)
    assert found.where("depth = 1").agg(F.sum("n_convs")).first()[0] == 4000
