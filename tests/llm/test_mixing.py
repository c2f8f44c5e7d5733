"""Mixing: targets, exact shares, permutations and the texts of the mix."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import FOLDER, load

from stayspark.llm import joins, mixing, queries, tokens


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 2**64 - 1))
def test_permutation_and_its_inverse(count, secret):
    index = np.arange(count)
    there = mixing.permuted(index, count, secret)
    assert sorted(there) == list(range(count))
    assert (mixing.unpermuted(there, count, secret) == index).all()


def test_permutations_differ_by_key():
    index = np.arange(1000)
    assert (mixing.permuted(index, 1000, 1) != mixing.permuted(index, 1000, 2)).mean() > 0.9
    assert abs(np.corrcoef(index, mixing.permuted(index, 1000, 7))[0, 1]) < 0.2


@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 10**6), max_size=12))
def test_targets(sizes):
    mix = mixing.Mix()
    found = mixing.targets(sizes, mix)
    assert set(found) == set(sizes)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(found[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    ordered = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    free = [found[s] / weight[s] for s in sizes if found[s] < 2 * sizes[s] - 1e-6]
    assert max(free, default=0) == pytest.approx(min(free, default=0))
    for s in sizes:  # what stopped would have had at least as much by weight
        assert not free or sizes[s] == 0 or found[s] / weight[s] <= free[0] + 1e-6


def check(rows, sizes, most=2):
    taken, total, target = Counter(), Counter(), {}
    for (key, source, size), row in zip(sizes, rows, strict=True):
        assert row["size"] == size and 0 <= row["taken"] <= most * size
        taken[source] += row["taken"]
        total[source] += size
        target[source] = row["target"]
    want = mixing.targets(dict(total), mixing.Mix())
    for source in total:
        assert taken[source] == int(want[source]) and target[source] == pytest.approx(want[source])


def test_whole_table_meets_its_targets_and_reruns_agree(spark):
    sizes = [(k, s, len(words(t))) for k, s, t in load("SELECT doc_id, source, text FROM documents ORDER BY 1")]
    query = queries.QUERIES["op4_mixing"]
    rows = query(spark, FOLDER).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [k for k, _, _ in sizes]
    check(rows, sizes)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert query(spark, FOLDER).orderBy("doc_id").collect() == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


ODD = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "one", None), (5, "  lead and\ttrail \n", "é"), (6, " ", "empty"),
    (None, "no id here", "x"), (7, "same words", "y"), (7, "same words", "y"), (8, "long text " * 5000, "z"),
    *[(100 + i, f"w{i} " * (i % 13), "hot") for i in range(400)],
]


def odd(spark, rows=ODD):
    schema = "doc_id long, text string, source string, n_chars int, start string, shard long"
    return spark.createDataFrame([(k, t, s, len(t or ""), "clash", 5) for k, t, s in rows], schema)


@pytest.mark.parametrize("block", [1, 3, 256, 100_000])
def test_odd_rows_by_block_length(spark, block):
    mix = mixing.Mix(block_words=block, shard_slots=50)
    rows = mixing.taken_words(odd(spark).repartition(3), mix).collect()
    size = Counter((k, len(words(t))) for k, t, _ in ODD)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == size
    source = {(k, len(words(t))): s for k, t, s in ODD}
    check(rows, [(r.doc_id, source[r.doc_id, r.size], r["size"]) for r in rows])


def test_slots_fill_shards_from_blocks(spark):
    mix = mixing.Mix(block_words=8, shard_slots=50)
    _, spans = mixing.mix_spans(odd(spark), mix)
    by_slot = Counter()
    shards = Counter()
    for r in spans.collect():
        by_slot[r.source_no, r.slot] += r["words"]
    assert max(by_slot.values()) <= 8
    for (number, slot), n in by_slot.items():
        shards[number] += 1
    assert spans.groupBy("source_no", "slot").agg({"shard": "min", "pass": "max"}).count() == len(by_slot)


@pytest.mark.parametrize("block", [3, 256])
def test_mixed_texts_hold_the_taken_words(spark, block):
    mix = mixing.Mix(block_words=block, shard_slots=50)
    docs = odd(spark)
    got = mixing.mixed_documents(docs, mix)
    assert got.columns == docs.columns
    rows = got.collect()
    taken = Counter()
    for r in mixing.taken_words(docs, mix).collect():
        taken[r.doc_id] += r.taken
    held = Counter()
    texts = {k: t for k, t, _ in ODD}
    for r in rows:
        held[r.doc_id] += len(words(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text) and r.start == "clash"
    assert +held == +taken


def test_no_rows_and_no_words(spark):
    assert mixing.taken_words(odd(spark, [])).collect() == []
    assert mixing.mixed_documents(odd(spark, [])).collect() == []
    empty = odd(spark, [(1, None, None), (2, " ", "a")])
    assert sorted(map(tuple, mixing.taken_words(empty).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixed_documents(empty).collect() == []


def test_more_sources_than_were_let_in(spark):
    rows = [(i, "a b c d e " * (1 + i % 7), f"site{i % 10_050}") for i in range(10_300)]
    got = mixing.taken_words(odd(spark, rows)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [k for k, _, _ in rows]
    check(got, [(k, s, len(words(t))) for k, t, s in rows])


@pytest.mark.parametrize("bound", [200_000, 0])
def test_sources_in_chunks_and_shuffled_joins(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(mixing, "CHUNK", 3)
    monkeypatch.setattr(mixing, "SHARDS", 2)
    rows = ODD + [(1000 + i, f"v{i} x y z " * (i % 9), f"s{i % 23}") for i in range(150)]
    mix = mixing.Mix(block_words=4, shard_slots=50)
    got = mixing.taken_words(odd(spark, rows).repartition(3), mix).collect()
    source = {(k, len(words(t))): s for k, t, s in rows}
    check(got, [(r.doc_id, source[r.doc_id, r["size"]], r["size"]) for r in got])
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len(words(t))) for k, t, _ in rows)


def test_draws_are_those_of_one_multinomial(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 2)
    slots = [4000, 1, 2500, 3000, 500]
    plan = spark.createDataFrame(list(enumerate(slots)), "source_no long, slots long")
    drawn, shards = mixing._draws(spark, plan, mixing.Mix(shard_slots=100))
    assert shards == 101
    got, by_shard = Counter(), Counter()
    for r in drawn.collect():
        got[r.source_no] += r.drawn
        by_shard[r.shard] += r.drawn
    assert by_shard == {i: 100 for i in range(shards)}
    assert all(abs(got[i] - n * 10_100 / 10_001) < 5 * n**0.5 + 5 for i, n in enumerate(slots))


def test_too_many_sources(spark):
    with pytest.raises(ValueError):
        mixing.taken_words(odd(spark), mixing.Mix(sources=2))


def rebuilt(sizes, mix):
    """Words taken per document, slot by slot and word by word: (doc_id, source, size) with ids that differ."""
    sources = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {source: sum(n for _, s, n in sizes if s == source) for source in sources}
    want = mixing.targets(total, mix)
    taken = Counter()
    for number, source in enumerate(sources):
        rows = sorted((k, n) for k, s, n in sizes if s == source)
        owner = [k for k, n in rows for _ in range(n)]
        blocks = [owner[at : at + mix.block_words] for at in range(0, len(owner), mix.block_words)]
        left, turn = int(want[source]), 0
        while left:
            secret = mixing.key(mix, number, turn)
            for block in mixing.permuted(np.arange(len(blocks)), len(blocks), secret).tolist():
                slot = blocks[block][:left]
                taken.update(slot)
                left -= len(slot)
            turn += 1
    return taken


def test_whole_table_equals_a_plain_rebuild(spark):
    sizes = [(k, s, len(words(t))) for k, s, t in load("SELECT doc_id, source, text FROM documents ORDER BY 1")]
    rows = queries.QUERIES["op4_mixing"](spark, FOLDER).collect()
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(rebuilt(sizes, mixing.Mix()))


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_odd_rows_equal_a_plain_rebuild(spark, block):
    mix = mixing.Mix(block_words=block, shard_slots=50)
    rows = [(k, t, s) for k, t, s in ODD if k is not None and k != 7]
    got = mixing.taken_words(odd(spark, rows).repartition(3), mix).collect()
    want = rebuilt([(k, s, len(words(t))) for k, t, s in rows], mix)
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(want)


def test_texts_reach_python_only_to_be_cut(spark):
    """One Arrow batch held all texts of a task, off the heap, and whole texts went through it too."""
    seen = "\t lead  and　trail \n" + "é𝄞 w\x0bx\x85y " * 40
    docs = odd(spark, [(i, seen + f" {i}", f"s{i % 3}") for i in range(60)])
    got = mixing.mixed_documents(docs, mixing.Mix(block_words=16, shard_slots=50))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
    rows = got.collect()
    whole = [r for r in rows if len(words(r.text)) == len(words(seen)) + 1]
    assert 0 < len(whole) < len(rows)
    assert all(r.text == seen + f" {r.doc_id}" for r in whole)
    for r in rows:
        assert r.n_chars == len(r.text) and r.text in seen + f" {r.doc_id}"
        assert r in whole or r.text == r.text.strip(" \t\n\x0b\x0c\r")


def test_a_worker_forgets_what_mixing_does_not_need():
    tokens.held(("model", 1), lambda: [0])
    assert mixing.cut_texts("a  b c", [{"first": 0, "words": 1}, {"first": 1, "words": 1}]) == ["a  b"]
    assert not tokens._held
    assert mixing.cut_texts(None, None) is None
