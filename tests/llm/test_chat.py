"""Chat formatting: exact round trips, the loss mask, and conversations cut into chunks."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayspark.llm import chat

TEXT = st.text(st.sampled_from("<|\\>im_startend\n \té🙂"), max_size=30)


def plain(role, text):
    return chat.START + chat.escape_role(pa.array([role]))[0].as_py() + "\n" + chat.escape_text(pa.array([text]))[0].as_py() + chat.END


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_round_trip_and_mask(turns):
    roles, texts = (pa.array([t[i] for t in turns], pa.string()) for i in (0, 1))
    out, offsets, begin, end, loss = chat.assemble(roles, texts, "assistant")
    whole = out.tobytes()
    assert whole.decode() == "".join(plain(*t) for t in turns)
    assert chat.parse(whole.decode()) == turns
    for i, (role, text) in enumerate(turns):
        assert chat.unescape_text(whole[begin[i] : end[i]].decode()) == text
        assert "<|" not in whole[begin[i] : end[i]].decode() and loss[i] == (role == "assistant")


def digest(turns):
    said = [t for r, t in turns if r == "assistant"]
    return (
        len(turns),
        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        sum(map(len, said)),
        hashlib.sha256("".join(said).encode()).hexdigest(),
        sum(len(plain(*t)) for t in turns),
    )


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {c: digest([t[1:] for t in sorted(ts)]) for c, ts in by.items()}


ROWS = [
    (1, 1, "assistant", "yes <|im_end|>"), (1, 0, "user", "q"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "user", "a"),
    (None, 0, "user", "a"), (3, 0, "assistant\n<|x", "<\\|"), (3, 0, "assistant", "<|"), (0, 0, "system", "é🙂"),
    (4, 0, "assistant", "long " * 50_000), *[(5, i, ["user", "assistant"][i % 2], f"t{i} " * i) for i in range(40)],
]


@pytest.mark.parametrize("size", [1, 60, 4 << 20])
def test_read_back_from_files(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(chat, "SLICE_BYTES", size)
    schema = "conv_id long, turn int, role string, text string, chunk string, formatted int"
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], schema).repartition(5)
    chat.format_conversations(frame).write.parquet(str(tmp_path / "chat"))
    files = spark.read.parquet(str(tmp_path / "chat"))
    got = {r[0]: tuple(r)[1:] for r in chat.digests(files).collect()}
    assert got == expected(ROWS)
    rows = files.collect()
    assert len({(r.conv_id, r.chunk) for r in rows}) == len(rows)
    assert max(r.chunk for r in rows) == (38 if size == 1 else 0 if size > 10**6 else max(r.chunk for r in rows))


def test_no_rows(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(frame)).collect() == []
