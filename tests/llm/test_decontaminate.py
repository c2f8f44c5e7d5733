"""Benchmark passages against a search word by word."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayspark.llm import decontaminate as dc


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    names |= {str(i) for i in found if i is not None}
        out.append((key, len(w), hit, sorted(names)))
    return sorted(out, key=str)


def found(spark, docs, items, size=10):
    frame = spark.createDataFrame([(k, t, 5, ["x"]) for k, t in docs], "doc_id long, text string, n_words int, items array<string>")
    bench = spark.createDataFrame([(k, t, "c") for k, t in items], "item_id long, text string, item string")
    rows = dc.find_items(frame.repartition(3), bench, size).withColumn("n_hit", dc.n_hit()).collect()
    out = []
    for r in rows:
        hit = {w for a, b in zip(r["hit"][::2], r["hit"][1::2], strict=True) for w in range(a, b)}
        assert r.n_hit == len(hit)
        out.append((r.doc_id, r.n_words, hit, r["items"]))
    return sorted(out, key=str)


TEN = "one two three four five six seven eight nine ten"
ITEMS = [
    (1, TEN), (2, TEN.upper() + " eleven"), (2, "eleven twelve"), (3, "a"), (4, None), (5, " .. "), (10, "É été ÉTÉ"), (None, "zz top"),
    (6, "one. two! (three) four"), (6, "one. two! (three) four"), (7, "w" * 70_000 + " end"), (8, "x y " * 40),
]
DOCS = [
    (1, TEN), (2, f"so {TEN}, Eleven TWELVE!"), (3, None), (4, ""), (5, "?!"), (6, "b A c"), (6, "b A c"), (None, "zz-top a"),
    (7, TEN + " " + TEN), (8, TEN[:-1]), (9, "ten" + TEN), (11, "été" * 3 + " É ÉtÉ été"), (12, "É été ÉTÉ"), (13, "y x " * 30),
    (14, "w" * 70_000 + " end"), (15, ("filler words " * 3000 + TEN + " ") * 3), (16, "one two three four"), (17, "\x00a\x00 a"),
]


def test_odd_rows(spark):
    assert found(spark, DOCS, ITEMS) == expected(DOCS, ITEMS)


@pytest.mark.parametrize("limit", [600, 4 << 20])
def test_blocks_pieces_lanes_and_slices(spark, monkeypatch, limit):
    for name, value in {"BLOCK_BYTES": limit, "PIECE_BYTES": 40, "LANE": 16, "SLICE_BYTES": 300, "PAIRS": 3}.items():
        monkeypatch.setattr(dc, name, value)
    rng = random.Random(2)

    def text(n):
        return " ".join(rng.choice(["a", "bb", "ab", "c", "É"]) for _ in range(n))

    items = [(i, text(rng.randrange(0, 40))) for i in range(12)]
    docs = [(i, text(rng.randrange(0, 90))) for i in range(30)] + [(30 + i, f"{text(5)} {t} {text(3)}") for i, t in items]
    assert found(spark, docs, items, 4) == expected(docs, items, 4)


def test_no_rows(spark):
    assert found(spark, DOCS, []) == expected(DOCS, [])
    assert found(spark, [], ITEMS) == []


ALPHABET = st.text(st.sampled_from("aAb. é\x00\n"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4), st.lists(ALPHABET, min_size=1, max_size=4), st.integers(1, 4))
def test_search_equals_loops(texts, items, size):
    normal = [dc.normal(pa.array([t], pa.string())) for t in items]
    table = pa.table({"text": [n.tobytes() for n in normal], "item": [str(i) for i in range(len(items))]})
    patterns = dc.Patterns(table, size)
    n_words, hit, names = patterns.find(pa.array(texts, pa.string()))
    want = {k: v for k, *v in expected(list(enumerate(texts)), list(enumerate(items)), size)}
    for k in range(len(texts)):
        stretches = zip(hit[k][::2], hit[k][1::2], strict=True)
        assert [n_words[k], {w for a, b in stretches for w in range(a, b)}, names[k]] == want[k]


def test_most_places_are_skipped():
    """The shortest pattern bounds the moves; among long ones most bytes are never looked at."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    item = " ".join(rng.choice(vocabulary) for _ in range(300))
    table = pa.table({"text": [dc.normal(pa.array([item])).tobytes()], "item": ["1"]})
    search = dc.Patterns(table, 10).searches[0]
    text = dc.normal(pa.array([" ".join(rng.choice(vocabulary) for _ in range(20_000))]))
    looked = 0
    plain = search._hash

    def counted(blocks):
        nonlocal looked
        looked += len(blocks)
        return plain(blocks)

    search._hash = counted
    search(np.append(text, np.zeros(8, np.uint8)), len(text))
    assert looked < len(text) / 8


def test_drop(spark):
    docs = spark.createDataFrame([(1, TEN, "k"), (2, "clean", "k"), (None, TEN, "k"), (3, "a b", "k")], "doc_id long, text string, _x string")
    bench = spark.createDataFrame(ITEMS[:4], "item_id long, text string")
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2]
    assert sorted(r.doc_id or 0 for r in dc.drop_contaminated(docs, bench, most=0.5).collect()) == [0, 2, 3]
