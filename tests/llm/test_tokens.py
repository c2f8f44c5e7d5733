"""Token files and packing against plain encoding with the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import FOLDER, documents, load, plain_encoder

from stayspark.llm import dac, packing, queries, token_files
from stayspark.llm.tokens import TextEncoder, text_slices

ODD = [
    "", " ", "It's  a\ttest\n", "İstanbul ΣΑΣ ΟΔΟΣ", "é ́e ạ́b", "<|endoftext|>x <|endoftext|>",
    "a b c\x85d\x1ce", "日本語 text 1234 don't", "\x0b\x0cab\r\n", "🙂🙂 <|startoftext|>", None, "x" * 3000,
    "word " * 5000, "<|ENDOFTEXT|> x. <|EndOfText|>.", "UPPER. Lower, (x) a-b! don't. it's, 'tis' end", "naïve… fin.? ÀÉÎ.,; ǅ. ŉ! ﬁn, ſ.",
    "e\u0301. a\u0323\u0301, \u0301x.", "\x00ctrl\x07. \x1b[0m, a\x00b.", "ΑΣ. ΑΣ, Σ.Α", "K. Å, ß. ẞ.", "<|endoftext|>. a<|startoftext|>b,",
]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_give_the_ids_of_whole_texts():
    plain = plain_encoder()
    ids, offsets = TextEncoder(queries.word_bpe())(pa.array(ODD, pa.string()))
    for row, text in enumerate(ODD):
        assert ids[offsets[row] : offsets[row + 1]].tolist() == plain(text)
    whole, same = TextEncoder(queries.word_bpe(), chunked=False)(pa.array(ODD, pa.string()))
    assert whole.tolist() == ids.tolist() and same.tolist() == offsets.tolist()


PIECES = ["a", "Word", "ß", "É", "e\u0301", "İ", "Σ", "'s", "'", ".", ",", "!?", "<|", "|>", "<|endoftext|>", "7", " ", "\n", "\x85", "\x00", "日", "🙂"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=4))
def test_chunks_of_any_kind(texts):
    for size in (0, 1000):
        encode = TextEncoder(queries.word_bpe(), cached=size) if size not in ENCODERS else ENCODERS[size]
        ENCODERS[size] = encode
        ids, offsets = encode(pa.array(texts, pa.string()))
        for row, text in enumerate(texts):
            assert ids[offsets[row] : offsets[row + 1]].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


ENCODERS = {}


def test_slices_cover_all_rows_once():
    texts = pa.array(["a" * n for n in (5, 0, 30, 1, 1, 12)] + [None])
    slices = list(text_slices(texts, 12))
    assert [i for a, b in slices for i in range(a, b)] == list(range(7))
    assert list(text_slices(pa.array([], pa.string()))) == []


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=3000
    )
)
def test_code_gives_any_position_and_run(ids):
    reader = dac.Dac(dac.encode(np.array(ids, "<u4")))
    assert len(reader) == len(ids)
    assert reader.run(0, len(ids)).tolist() == ids
    for at in range(0, len(ids), 7):
        assert reader[at] == ids[at]
        assert reader.run(at, min(at + 700, len(ids))).tolist() == ids[at : at + 700]


def test_code_refuses_what_it_does_not_hold():
    reader = dac.Dac(dac.encode(np.array([7, 70_000], "<u4")))
    with pytest.raises(IndexError):
        reader[2]
    with pytest.raises(IndexError):
        reader.run(1, 3)
    with pytest.raises(ValueError):
        dac.Dac(b"none")


def test_whole_table_reads_back_as_plain_ids(spark):
    plain = plain_encoder()
    start, want = 0, []
    for key, text in sorted(load("SELECT doc_id, text FROM documents")):
        ids = plain(text) + [2]
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.QUERIES["op1_token_files"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == want


def write(spark, docs, monkeypatch, segment=50):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", segment)
    folder = token_files.new_folder(spark, "test")
    token_files.write_token_files(docs, folder, queries.word_bpe(), end=2)
    return folder


def test_files_of_odd_rows(spark, monkeypatch):
    plain = plain_encoder()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, "other"), (None, "no id")]
    folder = write(spark, documents(spark, rows).repartition(3), monkeypatch)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    ids = [i for r in got for i in r.ids]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == sorted(
        (-1 if k is None else k, plain(t) + [2]) for k, t in rows
    )
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    places = [0, 3, 3, len(ids) - 1, len(ids), -1, None, *range(40, 400, 9)]
    frame = spark.createDataFrame([(p,) for p in places], "position long")
    found = {r.position: r.token for r in token_files.tokens_at(spark, folder, frame).collect()}
    assert found == {p: ids[p] for p in places if p is not None and 0 <= p < len(ids)}


def test_no_documents(spark, monkeypatch):
    none = documents(spark, [])
    assert token_files.read_token_files(spark, write(spark, none, monkeypatch)).collect() == []
    assert packing.pack(none, queries.word_bpe(), 1).collect() == []


def check_packing(rows, want, limits):
    """Every id once, in pieces that keep all limits and fill their sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for key, ids in want.items():
        pieces = sorted(by_doc[key], key=lambda r: r["start"])
        assert [i for r in pieces for i in np.frombuffer(r["ids"], "<u4")] == ids
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        lengths = [r["length"] for r in pieces]
        assert [r["offset"] for r in pieces] == np.cumsum([0] + lengths)[:-1].tolist()
        assert sum(lengths) <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r["n_loss"] for r in pieces) <= limits.loss
        if sum(lengths) & (sum(lengths) - 1):
            padding += limits.tokens - sum(lengths)
    return padding


def test_whole_table_packs_without_padding(spark):
    plain = plain_encoder()
    want = {k: plain(t) + [1] for k, t in load("SELECT doc_id, text FROM documents")}
    pieces = packing.pack(spark.read.parquet(f"{FOLDER}/documents.parquet"), queries.word_bpe(), 1)
    rows = [r.asDict() for r in pieces.collect()]
    assert check_packing(rows, want, packing.Limits()) == 0
    got = queries.QUERIES["op8_packing"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(
        (r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"]) for r in rows
    )


def test_prompts_bear_no_loss_and_all_limits_hold(spark):
    plain = plain_encoder()
    rows = [(i, "answer one two " * (i % 9), "question " * (i % 5) or None) for i in range(300)]
    rows += [(900, "long " * 700, "asked " * 300), (901, None, None), (902, "", "only a prompt")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2)
    limits = packing.Limits(tokens=64, segments=4, loss=24, pool=8)
    got = [r.asDict() for r in packing.pack(frame, queries.word_bpe(), 1, limits, "prompt").collect()]
    check_packing(got, {k: plain(p) + plain(t) + [1] for k, t, p in rows}, limits)
    prompts = {k: len(plain(p)) for k, t, p in rows}
    for r in got:
        first = max(r["start"], prompts[r["doc_id"]])
        assert r["n_loss"] == max(0, r["start"] + r["length"] - first)


def test_packing_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = [r.asDict() for r in packing.pack(documents(spark, rows), queries.word_bpe(), 1).collect()]
    plain = plain_encoder()
    check_packing(got, {k: plain(t) + [1] for k, t in rows}, packing.Limits())
    twice = packing.pack(documents(spark, [(1, "a b"), (1, "a b")]), queries.word_bpe(), 1).collect()
    assert {r.doc_id for r in twice} == {1} and sum(r.length for r in twice) == 6


def test_many_short_examples_need_no_padding(spark):
    rows = [(i, "a b" if i % 3 else "one two three") for i in range(3000)]
    got = [r.asDict() for r in packing.pack(documents(spark, rows), queries.word_bpe(), 1).collect()]
    plain = plain_encoder()
    assert check_packing(got, {k: plain(t) + [1] for k, t in rows}, packing.Limits()) == 0


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(segments=0))
