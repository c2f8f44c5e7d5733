"""Benchmark passages inside documents, by Wu-Manber search for all windows of all items at once.

Texts become their words, each after one space.  The windows of the items are the patterns.  A table over hashed blocks of bytes
says how far a search may move on from a block; where it may not, the block is the last one of the shortest length that
patterns have, its bucket names the patterns that have it there, and a comparison with the whole pattern decides.  A
slice of text is searched from many places at once, in step, so each move is one numpy operation.

Patterns of much differing lengths are searched for apart, as the shortest one bounds every move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.llm.tokens import gather_ranges, held, text_slices, tidy
from stayspark.session import durable

# Words in a window; items of fewer words are one window.
WINDOW = 10
# Text that is searched at a time, and the bytes between two places where a search starts.
SLICE_BYTES, LANE = 4 << 20, 2048
# Bytes of item text that a worker holds patterns of; more are searched for in several passes over the documents.
BLOCK_BYTES = 4 << 20
# Items are cut into pieces of about this many bytes, which overlap by a window less one word.
PIECE_BYTES = 64 << 10
# Patterns compared with text positions at a time.
PAIRS = 1 << 18
SPACE, STOP = 0x20, 0x00

FOUND = "n_words long, hit array<long>, items array<string>"


def _letters() -> np.ndarray:
    """Every byte as a word has it: A-Z lower-cased, a space for what separates words."""
    table = np.full(256, SPACE, np.uint8)
    for kept in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
        table[kept.start : kept.stop] = np.arange(kept.start, kept.stop)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LETTERS = _letters()


def normal(texts: pa.Array) -> np.ndarray:
    """All texts in one array of bytes: every word after one space, one more space and a stop after each text."""
    # A text is put between separators, the last of which becomes the stop.
    before, after, between = (pa.scalar(x, pa.large_binary()) for x in (b" ", b"  ", b""))
    padded = pc.binary_join_element_wise(before, texts.cast(pa.large_binary()), after, between)
    offsets = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    raw = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    out = LETTERS[raw]
    out[offsets[1:] - offsets[0] - 1] = STOP
    keep = out != SPACE  # and of several spaces the first
    keep[1:] |= keep[:-1].copy()
    keep[:1] = True
    return out[keep]


def windows(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and text of each window of ``size`` words in normal texts, with its outer spaces.

    A text of fewer words is one window; one without words has none.
    """
    gaps = np.flatnonzero(text == SPACE)
    owner = np.searchsorted(np.flatnonzero(text == STOP), gaps)
    count = np.bincount(owner, minlength=int((text == STOP).sum())) - 1  # words
    first = np.cumsum(count + 1) - (count + 1)  # index of each text's first gap
    n = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    start = gather_ranges(first, n)
    end = start + np.repeat(np.minimum(count, size), n)
    return gaps[start], gaps[end] - gaps[start] + 1, np.repeat(np.arange(len(n)), n)


def _words_at(data: np.ndarray, size: int) -> np.ndarray:
    """At each place the ``size`` (up to 8) bytes from there on as a number; the data must have 8 bytes to spare."""
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    return view & np.uint64((1 << (8 * size)) - 1) if size < 8 else view


class Search:
    """Patterns of nearly one length: shifts, buckets by the last block, and the patterns to compare with."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, name: np.ndarray):
        self.least = int(length.min())
        self.block = min(8, self.least)
        moves = self.least - self.block + 1
        # Some eight entries per block of a pattern, so that few blocks of other texts meet an entry.
        bits = min(max(int(8 * len(start) * moves - 1).bit_length(), 10), 22)
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, min(moves, 255), np.uint8)
        blocks = _words_at(data, self.block)
        for back in range(min(moves, 255) - 1, -1, -1):
            self.shift[self._hash(blocks[start + (self.least - self.block - back)])] = back
        last = blocks[start + (self.least - self.block)]
        order = np.argsort(last, kind="stable")
        self.bucket, self.first = np.unique(last[order], return_index=True)
        self.size = np.diff(np.append(self.first, len(order)))
        self.start, self.length, self.name = start[order], length[order], name[order]
        self.data = data
        self.head = blocks[self.start]

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> self.drop

    def _stops(self, blocks: np.ndarray, size: int) -> np.ndarray:
        """Places where a pattern's last block may stand, by moving on from many places in step."""
        at = np.arange(0, max(size - self.least + 1, 0), LANE) + (self.least - self.block)
        until = np.minimum(at + LANE, size - self.block + 1)
        found = []
        while len(at):
            move = self.shift[self._hash(blocks[at])]
            stop = move == 0
            found.append(at[stop])
            at = at + np.maximum(move, 1)
            going = at < until
            if not going.all():
                at, until = at[going], until[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def __call__(self, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of every occurrence in ``text``, of which ``size`` bytes count."""
        blocks = _words_at(text, self.block)
        at = self._stops(blocks, size)
        place = np.minimum(np.searchsorted(self.bucket, blocks[at]), len(self.bucket) - 1)
        known = self.bucket[place] == blocks[at]
        at, place = at[known] - (self.least - self.block), place[known]
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        starts, patterns = [], []
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            where = np.repeat(at[first:last], sizes[first:last])
            which = gather_ranges(self.first[place[first:last]], sizes[first:last])
            near = (blocks[where] == self.head[which]) & (where + self.length[which] <= size)
            where, which = where[near], which[near]
            same = np.fromiter(map(partial(self._same, text), where.tolist(), which.tolist()), bool, len(where))
            starts.append(where[same])
            patterns.append(which[same])
            first = last
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(patterns)

    def _same(self, text: np.ndarray, at: int, which: int) -> bool:
        start, length = int(self.start[which]), int(self.length[which])
        return text[at : at + length].tobytes() == self.data[start : start + length].tobytes()


class Patterns:
    """The windows of a block of items, and which items have each."""

    def __init__(self, items: pa.Table, size: int):
        """``items`` have ``text``, normal already, and ``item`` as text, null for items without a name."""
        self.searches: list[Search] = []
        data = np.frombuffer(b"".join(items.column("text").to_pylist()), np.uint8)
        start, length, owner = windows(data, size)
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        names = items.column("item").to_pylist()
        # Equal windows are one pattern.
        raw = data.tobytes()
        seen: dict[bytes, int] = {}
        number = np.fromiter(
            (seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(start.tolist(), length.tolist(), strict=True)),
            np.int64, len(start),
        )
        _, first = np.unique(number, return_index=True)
        order = np.argsort(number, kind="stable")
        ends = np.searchsorted(number[order], np.arange(len(first)), "right")
        self.items, self.owner, self.ends = names, owner[order], ends
        start, length = start[first], length[first]
        classes = np.frexp(length)[1]  # doubling lengths
        for c in np.unique(classes):
            of = np.flatnonzero(classes == c)
            self.searches.append(Search(data, start[of], length[of], of))

    def names(self, patterns: np.ndarray) -> set[str]:
        """The items that have any of the patterns."""
        begin = np.where(patterns > 0, self.ends[patterns - 1], 0)
        owners = np.unique(self.owner[gather_ranges(begin, self.ends[patterns] - begin)])
        return {self.items[o] for o in owners} - {None}

    def find(self, texts: pa.Array) -> tuple[np.ndarray, list, list]:
        """Of each text the number of its words, its hit stretches of words (first, one past the last, in turn), and items."""
        text = normal(texts)
        gaps, stops = np.flatnonzero(text == SPACE), np.flatnonzero(text == STOP)
        first = np.searchsorted(gaps, np.concatenate(([0], stops[:-1])))  # of each text its first gap
        n_words = np.diff(np.append(first, len(gaps))) - 1
        spare = np.concatenate([text, np.zeros(8, np.uint8)])
        begin, end, pattern = [], [], []
        for search in self.searches:
            at, which = search(spare, len(text))
            begin.append(np.searchsorted(gaps, at))
            end.append(np.searchsorted(gaps, at + search.length[which] - 1))
            pattern.append(search.name[which])
        hit: list[list[int]] = [[] for _ in range(len(texts))]
        items: list[list[str]] = [[] for _ in range(len(texts))]
        if sum(map(len, begin)):
            begin, end, pattern = (np.concatenate(x) for x in (begin, end, pattern))
            order = np.argsort(begin, kind="stable")
            begin, end, pattern = begin[order], end[order], pattern[order]
            owner = np.searchsorted(first, begin, "right") - 1
            marks = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(marks, np.append(marks[1:], len(owner)), strict=True):
                row = int(owner[a])
                reach = np.maximum.accumulate(end[a:b])
                new = np.concatenate(([True], begin[a + 1 : b] > reach[:-1]))
                last = np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)
                hit[row] = (np.stack([begin[a:b][new], reach[last]], 1).ravel() - first[row]).tolist()
                items[row] = sorted(self.names(np.unique(pattern[a:b])))
        return n_words, hit, items


def _merged(one: list[int], other: list[int]) -> list[int]:
    """The union of two lists of stretches."""
    out: list[int] = []
    for a, b in sorted([*zip(one[::2], one[1::2], strict=True), *zip(other[::2], other[1::2], strict=True)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _searching(items: pa.Table, size: int) -> Callable:
    """An Arrow function that adds what a block of items finds to what others have found before."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, items.schema) as out:
        out.write_table(items)
    blob = sink.getvalue().to_pybytes()
    name = hashlib.sha256(blob).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held(("windows", name, size), lambda: Patterns(pa.ipc.open_stream(blob).read_all(), size))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for first, last in text_slices(texts, SLICE_BYTES):
                part = batch.slice(first, last - first)
                n_words, hit, names = patterns.find(texts.slice(first, last - first))
                before = zip(part.column("hit").to_pylist(), part.column("items").to_pylist(), strict=True)
                for row, (h, n) in enumerate(before):
                    if h:
                        hit[row] = _merged(h, hit[row])
                        names[row] = sorted({*n, *names[row]})
                columns = [pa.array(n_words), pa.array(hit, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
                kept = [c for c in part.schema.names if c not in ("n_words", "hit", "items")]
                yield pa.record_batch(
                    [*(part.column(c) for c in kept), *columns], [*kept, "n_words", "hit", "items"]
                )

    return run


def _pieces(size: int) -> Callable:
    """An Arrow function that cuts the normal texts of items into pieces that together have the same windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for row in range(len(texts)):
                text = normal(texts.slice(row, 1))[:-1]
                gaps = np.flatnonzero(text == SPACE)
                at = 0
                while at < len(gaps) - 1:
                    end = int(np.searchsorted(gaps, gaps[at] + PIECE_BYTES))
                    end = min(max(end, at + size), len(gaps) - 1)
                    piece = text[gaps[at] : gaps[end] + 1].tobytes() + bytes([STOP])
                    yield pa.record_batch(
                        [batch.column("item").slice(row, 1), pa.array([piece], pa.binary())], ["item", "text"]
                    )
                    at = len(gaps) if end == len(gaps) - 1 else end - size + 1

    return run


def item_blocks(items: DataFrame, size: int = WINDOW) -> Iterator[pa.Table]:
    """The items cut into pieces, in blocks of about ``BLOCK_BYTES``, one after the other."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string"))
    pieces = durable(rows.mapInArrow(_pieces(size), "item string, text binary").distinct())
    held_bytes = pieces.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-2 * held_bytes // BLOCK_BYTES))
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for block in range(blocks if held_bytes else 0):
        yield pieces.where(dealt == block).toArrow()


def find_items(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``hit`` and ``items`` of every row of ``docs``: where its words stand inside a window of an item.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased.  A window is ``size`` consecutive words of an item;
    an item of fewer is one.  ``hit`` holds stretches of words, first and one past the last in turn; ``items`` the
    ids, as sorted strings, of the items with windows here.

    Null and wordless texts have no words and no windows.  An item without an id marks words, but is not named; repeated
    rows change nothing among items, and are rows of their own among documents.  Empty tables give no rows, or
    no hits.  Other columns are ignored.

    Items are taken in blocks of a bounded size.  There is one pass over the documents for each, and what one has found
    travels with the text to the next.
    """
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in FOUND.split(", ")}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(none)
    schema = "doc_id long, text string, " + FOUND
    empty = pa.table({"item": pa.array([], pa.string()), "text": pa.array([], pa.binary())})
    blocks = item_blocks(items, size)
    block = next(blocks, empty)
    while block is not None:
        following = next(blocks, None)
        if following is None:
            # The last pass has no more use for the texts.
            last = _searching(block, size)
            short = schema.replace("text string, ", "")
            return rows.mapInArrow(tidy(_without_text(last)), short)
        rows = durable(rows.mapInArrow(tidy(_searching(block, size)), schema))
        block = following
    return rows


def _without_text(run: Callable) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select([c for c in batch.schema.names if c != "text"])

    return cut


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, most: float = 0.0) -> DataFrame:
    """``docs`` without the rows of which more than the share ``most`` of the words is hit; all columns unchanged.

    Rows with one ``doc_id`` are judged together by the worst of them; those without an id stay.
    """
    found = find_items(docs, items, size)
    bad = found.where(n_hit() > F.lit(most) * F.col("n_words")).select(F.col("doc_id").alias("_hit_id"))
    return docs.join(bad.distinct(), docs["doc_id"] == F.col("_hit_id"), "left_anti")


def n_hit() -> Column:
    """The number of words in the stretches of ``hit``."""
    return F.aggregate(
        F.transform("hit", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
