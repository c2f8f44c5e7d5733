"""Directly addressable codes: token ids in chunk levels, with access to any position.

An id is cut into chunks of 8, 8 and 16 bits, low bits first.  Level 0 has the first chunk of every id;
a bit for each of its chunks says whether the id goes on, and the chunks of those that do form
level 1, and so on.  A directory of the set bits before every 512th position turns "the k-th id that
goes on" into a look-up, so one id, or a run of them, is read without decoding what stands before.

Bytes, little-endian: ``DAC1``, uint32 number of levels, uint64 lengths of the levels; then for
each level its chunks, its bits as uint64 words (whole groups of eight), and its directory
as uint64 values, each part padded to 8 bytes.  The last level has neither bits nor directory.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DAC1"
WIDTHS = (8, 8, 16)
CHUNK = {8: np.dtype("<u1"), 16: np.dtype("<u2")}
GROUP = 512


def _padded(part: np.ndarray) -> bytes:
    raw = part.tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def encode(ids: np.ndarray) -> bytes:
    """The code of an array of ids below 2**32."""
    rest = np.asarray(ids, "<u4")
    parts, lengths = [], []
    for level, width in enumerate(WIDTHS):
        lengths.append(len(rest))
        parts.append(_padded((rest & ((1 << width) - 1)).astype(CHUNK[width])))
        if level + 1 == len(WIDTHS):
            break
        rest = rest >> np.uint32(width)
        more = rest != 0
        bits = np.zeros(-(-len(more) // GROUP) * GROUP // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        words = bits.view("<u8")
        ones = np.bitwise_count(words).reshape(-1, GROUP // 64).sum(axis=1, dtype="<u8")
        parts += [words.tobytes(), _padded(np.cumsum(ones, dtype="<u8") - ones)]
        rest = rest[more]
    head = MAGIC + np.uint32(len(WIDTHS)).tobytes() + np.array(lengths, "<u8").tobytes()
    return head + b"".join(parts)


class Dac:
    """Reads a code; the bytes stay as they are and only what is asked for is touched."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        lengths = np.frombuffer(data, "<u8", levels, 8).astype(np.int64)
        at = 8 + 8 * levels
        self.levels = []
        for level, (width, n) in enumerate(zip(WIDTHS, lengths, strict=True)):
            kind = CHUNK[width]
            chunks = np.frombuffer(data, kind, n, at)
            at += -(-n * kind.itemsize // 8) * 8
            words = ranks = None
            if level + 1 < levels:
                groups = -(-int(n) // GROUP)
                words = np.frombuffer(data, "<u8", groups * GROUP // 64, at)
                at += groups * GROUP // 8
                ranks = np.frombuffer(data, "<u8", groups, at)
                at += groups * 8
            self.levels.append((chunks, words, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """Set bits before position ``at``: one directory entry and at most eight words."""
        group, inside = divmod(int(at), GROUP)
        if group == len(ranks):
            if not group:
                return 0
            group, inside = group - 1, GROUP
        first = group * (GROUP // 64)
        whole, bits = divmod(inside, 64)
        ones = int(ranks[group]) + int(np.bitwise_count(words[first : first + whole]).sum())
        if bits:
            ones += (int(words[first + whole]) & ((1 << bits) - 1)).bit_count()
        return ones

    def __getitem__(self, at: int) -> int:
        """The id at one position."""
        at = int(at)
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = shift = 0
        for (chunks, words, ranks), width in zip(self.levels, WIDTHS, strict=True):
            value |= int(chunks[at]) << shift
            shift += width
            if words is None or not int(words[at >> 6]) >> (at & 63) & 1:
                return value
            at = self._rank(words, ranks, at)
        return value

    def run(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start`` to ``stop - 1``; a run is also a run on every level."""
        if not 0 <= start <= stop <= len(self):
            raise IndexError((start, stop))
        return self._run(0, start, stop)

    def _run(self, level: int, start: int, stop: int) -> np.ndarray:
        chunks, words, ranks = self.levels[level]
        ids = chunks[start:stop].astype("<u4")
        if words is None or start == stop:
            return ids
        first = start >> 6
        covered = words[first : ((stop - 1) >> 6) + 1]
        bits = np.unpackbits(covered.view(np.uint8), bitorder="little")
        more = bits[start - (first << 6) : stop - (first << 6)].astype(bool)
        if more.any():
            below = self._rank(words, ranks, start)
            higher = self._run(level + 1, below, below + int(more.sum()))
            ids[more] |= higher << np.uint32(WIDTHS[level])
        return ids
