"""Conversations as training text: a template, a loss mask, and the way back.

A turn is ``<|im_start|>role``, a line end, its text, ``<|im_end|>`` and a line end.  Inside texts every ``<``
with any backslashes and a ``|`` after them gets one more backslash, so no text holds ``<|`` and
taking one backslash away restores it.  In roles, backslash, line end and ``<`` are written ``\\\\``, ``\\n`` and ``\\l``.

Turns are assembled by column: lengths, offsets and scatter indices in numpy, all bytes of a slice in
one buffer that becomes the Arrow column as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayspark.llm.tokens import gather_ranges, text_slices

START, END = "<|im_start|>", "<|im_end|>\n"
# Text of turns that is assembled at a time.  A conversation beyond it comes in several chunks.
SLICE_BYTES = 4 << 20
FORMATTED = (
    "conv_id long, chunk long, n_turns long, formatted string, "
    "loss_start array<long>, loss_end array<long>"
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()), ("chunk", pa.int64()), ("n_turns", pa.int64()),
        ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())),
        ("loss_end", pa.list_(pa.int64())),
    ]
)


def escape_text(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    for mark, written in (("\\", "\\\\"), ("\n", "\\n"), ("<", "\\l")):
        roles = pc.replace_substring(roles, mark, written)
    return roles


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the length of each string."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], np.diff(offsets).astype(np.int64)


def assemble(roles: pa.Array, texts: pa.Array, loss_role: str) -> tuple:
    """The bytes of all turns, the offset of each, and where the text of each begins and ends."""
    loss = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False)
    role, role_size = _bytes(escape_role(roles))
    text, text_size = _bytes(escape_text(texts))
    head, line, tail = (np.frombuffer(s.encode(), np.uint8) for s in (START, "\n", END))
    size = len(head) + role_size + len(line) + text_size + len(tail)
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(offsets[-1], np.uint8)
    role_at = offsets[:-1] + len(head)
    text_at = role_at + role_size + len(line)
    out[offsets[:-1, None] + np.arange(len(head))] = head
    out[gather_ranges(role_at, role_size)] = role
    out[text_at - 1] = line[0]
    out[gather_ranges(text_at, text_size)] = text
    out[(text_at + text_size)[:, None] + np.arange(len(tail))] = tail
    return out, offsets, text_at, text_at + text_size, loss


def _chunks(rows: pa.RecordBatch, first_chunk: int, loss_role: str) -> pa.RecordBatch:
    """One row per conversation in ``rows``; the first of them starts with chunk ``first_chunk``."""
    ids = rows.column("conv_id")
    out, offsets, begin, end, loss = assemble(rows.column("role"), rows.column("text"), loss_role)
    known, none = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    new = np.concatenate(([True], (known[1:] != known[:-1]) | (none[1:] != none[:-1])))
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(known))
    conversation = np.cumsum(new) - 1
    text_offsets = np.append(offsets[starts], offsets[-1])
    base = text_offsets[conversation]
    lists = np.concatenate(([0], np.cumsum(np.bincount(conversation[loss], minlength=len(starts)))))
    lists = pa.array(lists.astype(np.int32))
    chunk = np.zeros(len(starts), np.int64)
    chunk[0] = first_chunk
    formatted = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(text_offsets.astype(np.int32)), pa.py_buffer(out)
    )
    return pa.record_batch(
        [
            ids.take(pa.array(starts)), pa.array(chunk), pa.array(stops - starts), formatted,
            pa.ListArray.from_arrays(lists, pa.array((begin - base)[loss])),
            pa.ListArray.from_arrays(lists, pa.array((end - base)[loss])),
        ],
        schema=SCHEMA,
    )


def _format(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # turns of the last conversation, not yet put out
        chunk, cut = 0, None  # chunks of the conversation ``cut`` that are out already

        for batch in batches:
            for first, last in text_slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, last - first)
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                keys = part.column("conv_id").to_pylist()
                if chunk and keys[0] != cut:
                    chunk = 0
                last_from = keys.index(keys[-1])
                if last_from:
                    yield _chunks(part.slice(0, last_from), chunk, loss_role)
                    chunk = 0
                held = part.slice(last_from)
                if pc.sum(pc.binary_length(held.column("text"))).as_py() >= SLICE_BYTES:
                    yield _chunks(held, chunk, loss_role)
                    held, chunk, cut = None, chunk + 1, keys[-1]
        if held is not None:
            yield _chunks(held, chunk if held.column("conv_id")[0].as_py() == cut else 0, loss_role)

    return run


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted text of ``conv_id``, ``turn``, ``role``, ``text`` rows.

    Returned: ``conv_id``, ``chunk``, ``n_turns``, ``formatted``, and the loss mask as byte offsets: the text of turns
    by ``loss_role``.  A conversation is one row, ``chunk`` 0, unless its text exceeds a slice:
    then its chunks follow each other, cut between turns.

    Turns stand in ascending order, null first, equal ones by role and text.  Null text or role is
    empty; null ids make one conversation; repeated rows are turns of their own; an empty table gives
    no rows; other columns are ignored.  Turns stream through a task in bounded slices, however long a conversation is.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(loss_role), FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((unescape_role(role), unescape_text(text.removesuffix(END))))
    return turns


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    class Sums:
        def __init__(self, key):
            self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted: str, spans) -> None:
            for role, text in parse(formatted):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
            raw = formatted.encode()
            for a, b in spans:
                text = unescape_text(raw[a:b].decode())
                self.loss_chars += len(text)
                self.loss.update(text.encode())
            self.chars += len(formatted)

        def row(self) -> list:
            return [self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]

    def batch_of(done: list[Sums]) -> pa.RecordBatch:
        columns = zip(*(s.row() for s in done), strict=True)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    open_: Sums | None = None
    for batch in batches:
        done = []
        columns = [batch.column(c) for c in ("conv_id", "formatted", "loss_start", "loss_end")]
        for row in range(batch.num_rows):
            key, formatted, begins, ends = (c[row].as_py() for c in columns)
            if open_ is None or open_.key != key:
                done += [open_] if open_ is not None else []
                open_ = Sums(key)
            open_.add(formatted, zip(begins, ends, strict=True))
        if done:
            yield batch_of(done)
    if open_ is not None:
        yield batch_of([open_])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: turns, checksums and lengths (``DIGEST``).

    Chunks stream in order through the checksums, which hold no text.
    """
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return dealt.mapInArrow(_digests, DIGEST)
