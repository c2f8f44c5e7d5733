"""Packing examples into training sequences as vector bin packing.

Every sequence has three limits: tokens, segments (pieces of examples) and loss-bearing tokens.  A
sequence is filled by the dot-product heuristic: of the waiting pieces that fit under all limits, the
one whose demand vector has the largest dot product with the sequence's remaining room, each part
relative to its limit.  When nothing fits, the best piece is cut to the room that is left.

Each task packs its own stretch of the input with a bounded pool of waiting pieces, so nothing is
shuffled and no token waits for more than a pool.  A sequence that ends short, at another limit
or at the end of a task, is cut into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayspark.llm.tokens import CACHED_CHUNKS, SLICE_BYTES, encoder, text_slices, tidy


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold.  ``pool`` pieces wait at most while a sequence is chosen."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    pool: int = 1024


PIECE = (
    "doc_id long, start long, length long, doc_tokens long, n_loss long, "
    "sequence_id long, offset long, ids binary"
)


class Packer:
    """Packs a stream of examples; ``done`` collects pieces of closed sequences.

    A piece is ``(example, start, length, loss, sequence, offset)``.  The first ``prompt`` tokens of
    an example bear no loss, the others do.  ``rest`` makes of an example the one that waits, given where
    its waiting tokens start.
    """

    def __init__(self, limits: Limits, first_sequence: int = 0, rest: Callable = lambda e, start: e):
        if min(limits.tokens, limits.segments, limits.loss, limits.pool) < 1:
            raise ValueError("every limit must be positive")
        self.limits, self.rest = limits, rest
        self.sequence = first_sequence
        self.done: list[tuple] = []
        self.size = 0
        room = 2 * limits.pool
        self.start, self.left, self.prompt = (np.zeros(room, np.int64) for _ in range(3))
        self.example: list = [None] * room
        self._open()

    def _open(self) -> None:
        self.held: list[tuple] = []
        self.tokens, self.loss = self.limits.tokens, self.limits.loss

    def _close(self) -> None:
        """End the sequence; one that is not full is cut into stretches of a power of two."""
        total = sum(piece[2] for piece in self.held)
        offset = room = 0
        for example, start, length, loss in self.held:
            unpaid = length - loss  # the tokens before the first that bears loss
            while length:
                if not room:
                    self.sequence += offset > 0
                    full = total == self.limits.tokens
                    offset, room = 0, total if full else 1 << (total.bit_length() - 1)
                part = min(length, room)
                free = min(unpaid, part)
                self.done.append((example, start, part, part - free, self.sequence, offset))
                start, length, unpaid = start + part, length - part, unpaid - free
                offset, room, total = offset + part, room - part, total - part
        self.sequence += 1
        self._open()

    def _place(self, example, start: int, length: int, prompt: int) -> None:
        loss = max(0, start + length - max(start, prompt))
        self.held.append((example, start, length, loss))
        self.tokens -= length
        self.loss -= loss
        if not self.tokens or not self.loss or len(self.held) == self.limits.segments:
            self._close()

    def add(self, example, tokens: int, prompt: int = 0) -> None:
        """An example of ``tokens`` tokens; stretches that fill a sequence alone are placed at once."""
        start = 0
        while tokens - start >= self.limits.tokens:
            length = min(self.limits.tokens, max(0, prompt - start) + self.limits.loss)
            loss = max(0, start + length - max(start, prompt))
            self.done.append((example, start, length, loss, self.sequence, 0))
            # The sequence being filled goes on under the next number.
            self.sequence += 1
            start += length
        if start == tokens:
            return
        at = self.size
        self.start[at], self.left[at], self.prompt[at] = start, tokens - start, prompt
        self.example[at] = self.rest(example, start)
        self.size += 1
        if self.size == len(self.example):
            self._fill(self.limits.pool)

    def finish(self) -> None:
        """Place all that waits."""
        self._fill(0)
        if self.held:
            self._close()

    def _fill(self, until: int) -> None:
        limits = self.limits
        while self.size > until:
            n = self.size
            start, left, prompt = self.start[:n], self.left[:n], self.prompt[:n]
            unpaid = np.clip(prompt - start, 0, left)
            loss = left - unpaid
            gain = (
                left * (self.tokens / limits.tokens**2)
                + loss * (self.loss / limits.loss**2)
                + (limits.segments - len(self.held)) / limits.segments**2
            )
            fits = (left <= self.tokens) & (loss <= self.loss)
            if fits.any():
                best = int(np.where(fits, gain, -1.0).argmax())
            else:
                best = int(gain.argmax())
            length = min(int(left[best]), self.tokens, int(unpaid[best]) + self.loss)
            self._place(self.example[best], int(start[best]), length, int(prompt[best]))
            if length < left[best]:
                start[best] += length
                left[best] -= length
            else:
                self.size = last = n - 1
                for column in (self.start, self.left, self.prompt):
                    column[best] = column[last]
                self.example[best], self.example[last] = self.example[last], None


def _pack(
    path: str, chunked: bool, end: int, limits: Limits, slice_bytes: int, cached: int
) -> Callable:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = [column.split()[0] for column in PIECE.split(", ")]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in kinds]
        for (key, ids, base, size), start, length, loss, sequence, offset in done:
            piece = ids[start - base : start - base + length].tobytes()
            for column, value in zip(
                columns, (key, start, length, size, loss, sequence, offset, piece), strict=True
            ):
                column.append(value)
        done.clear()
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.record_batch(arrays, names)

    def waiting(example: tuple, start: int) -> tuple:
        """A waiting example holds a copy of the ids that wait, less than a sequence, and nothing else."""
        key, ids, _, size = example
        return key, ids[start:].copy(), start, size

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, chunked, cached)
        packer = Packer(limits, TaskContext.get().partitionId() << 40, waiting)
        for batch in batches:
            texts, prompts, keys = (batch.column(c) for c in ("text", "prompt", "doc_id"))
            for first, last in text_slices(texts, slice_bytes):
                count = last - first
                ids, offsets = encode.with_end(texts.slice(first, count), end)
                before, starts = encode(prompts.slice(first, count))
                prompt_sizes = np.diff(starts)
                for row, key in enumerate(keys.slice(first, count).to_pylist()):
                    own, head = ids[offsets[row] : offsets[row + 1]], int(prompt_sizes[row])
                    if head:
                        own = np.concatenate((before[starts[row] : starts[row + 1]], own))
                    packer.add((key, own, 0, len(own)), len(own), head)
                if packer.done:
                    yield rows(packer.done)
        packer.finish()
        if packer.done:
            yield rows(packer.done)

    return pack


def pack(
    examples: DataFrame,
    tokenizer: str,
    end: int,
    limits: Limits = Limits(),
    prompt: str | None = None,
    chunked: bool = True,
    slice_bytes: int = SLICE_BYTES,
    cached: int = CACHED_CHUNKS,
) -> DataFrame:
    """Pack ``doc_id``, ``text`` rows into sequences; one row per piece, with its token ids.

    An example is the ids of its prompt (column ``prompt``, if any), of its text, and ``end``; only
    the prompt's bear no loss.  Returned: ``doc_id``, ``start`` (its example's tokens before it),
    ``length``, ``doc_tokens`` (of the example), ``n_loss``, ``sequence_id``, ``offset`` in the
    sequence, and ``ids`` as little-endian unsigned 32-bit integers.  A sequence's offsets run from
    0 without gaps.  Every token is in exactly one piece.

    Null text is empty (its example is ``end`` alone); a repeated row is an example of its own; an
    empty table gives no rows; other columns are ignored.  Sequence ids are the task's number times
    2**40 plus a counter, so they are unique, not dense.

    ``slice_bytes`` of text are encoded at a time and ``cached`` words remembered: less of either takes
    less memory and more time, and gives the same pieces.
    """
    head = F.lit("") if prompt is None else F.col(prompt).cast("string")
    rows = examples.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), head.alias("prompt")
    )
    return rows.mapInArrow(
        tidy(_pack(tokenizer, chunked, end, limits, slice_bytes, cached)), PIECE
    )
