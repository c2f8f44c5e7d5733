"""Token ids of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are taken in slices of about this many bytes, so that a batch of long texts needs no more
# working memory than a batch of short ones (one text is never cut).
SLICE_BYTES = 8 << 20
# Words whose ids a worker remembers, some 40 bytes each, and words that are encoded at a time.
CACHED_CHUNKS, BLOCK_WORDS = 1_500_000, 1000
# A word with marks at its end, after a Latin or Cyrillic letter that stays one letter in any case (not the dotted I).
# An apostrophe may belong to letters after it.
MARKED = r"(?s)^(?P<stem>.*[A-Za-zÀ-ÖØ-öø-įı-ſЀ-џ])(?P<marks>[!-&(-/:-@\[-`{-~]+)$"
# Lower-case words that no normalizer changes, and all their letters.
PLAIN, PLAIN_LETTERS = "^[a-zß-öø-ÿ]+$", "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[first, last)`` of at most ``limit`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first = last


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges, range after range."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


class TextEncoder:
    """Ids of whole texts by the tokenizers library, one file of a public tokenizer.

    ``chunked`` is for tokenizers that drop white space and never look across it, part letters from
    marks after them, and take A-Z as a-z, such as the word-end BPE: a text's ids are
    then those of its white-space separated chunks, one after the other, so every distinct word is encoded
    once per worker, as long as it has room to remember them.  For any other tokenizer pass False, and
    whole texts are encoded.
    """

    def __init__(self, path: str, chunked: bool = True, cached: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked, self.cached = chunked, cached
        # The same without the steps that leave plain words as they are, if so.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = " ".join([PLAIN_LETTERS, *PLAIN_LETTERS])
        one, other = (t.encode(probe, add_special_tokens=False).ids for t in (self.tokenizer, self.plain))
        self.has_plain = one == other
        # Words that have been seen: their text, and where their ids stand in one pool.
        self.known = pa.array([], pa.string())
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = None
        if suffix:
            self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lists = [e.ids for e in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _words(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """As ``_alone``, of words of letters only: encoded many at a time, parted after the ids that close a word."""
        ids, sizes = [], []
        tokenizer = self.plain if plain else self.tokenizer
        for first in range(0, len(words), BLOCK_WORDS):
            block = words[first : first + BLOCK_WORDS]
            flat = np.array(tokenizer.encode(" ".join(block), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closing[flat]) + 1
            if len(ends) == len(block):
                ids.append(flat)
                sizes.append(np.diff(ends, prepend=0))
            else:  # a letter whose lower case is not one letter
                for kept, found in zip((ids, sizes), self._alone(block), strict=True):
                    kept.append(found)
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it those of each of the distinct ``words`` start and end."""
        at = pc.index_in(words, value_set=self.known)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if not missing.any():
            return self.pool, self.ends[place], self.ends[place + 1]
        new = words.filter(pa.array(missing))
        # 0: plain words, 1: other words of letters, 2: the rest
        plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False) & self.has_plain
        kind = np.where(plain, 0, np.where(pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False), 1, 2))
        if self.closing is None:
            kind[:] = 2
        order = np.argsort(kind, kind="stable")
        new = new.take(pa.array(order))
        parts, first = [], 0
        for k, count in enumerate(np.bincount(kind, minlength=3).tolist()):
            if count:
                texts = new.slice(first, count).to_pylist()
                parts.append(self._alone(texts) if k == 2 else self._words(texts, plain=k == 0))
            first += count
        pool = np.concatenate([self.pool, *[p[0] for p in parts]])
        ends = np.concatenate([self.ends[-1:], *[p[1] for p in parts]]).cumsum()
        ends = np.concatenate([self.ends, ends[1:]])
        place[np.flatnonzero(missing)[order]] = len(self.known) + np.arange(len(new))
        room = min(max(self.cached - len(self.known), 0), len(new))
        if room:
            self.known = pa.concat_arrays([self.known, new[:room]])
            self.ends = ends[: len(self.known) + 1]
            self.pool = pool[: self.ends[-1]]
        return pool, ends[place], ends[place + 1]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after the other, and how many each has.

        Marks at the end of a word are encoded apart: the tokenizer parts them from letters anyway.
        """
        found = pc.extract_regex(chunks, MARKED)
        marked = pc.and_(pc.is_valid(found), pc.invert(pc.match_substring(chunks, "<|")))
        stems = pc.if_else(marked, pc.struct_field(found, "stem"), chunks)
        marks = pc.if_else(marked, pc.struct_field(found, "marks"), "")
        words = pa.concat_arrays([stems, marks]).dictionary_encode()
        code = words.indices.to_numpy().reshape(2, -1).T.ravel()  # stem and marks of each chunk
        pool, start, end = self._ids(words.dictionary)
        sizes = (end - start)[code]
        return pool[gather_ranges(start[code], sizes)], sizes.reshape(-1, 2).sum(axis=1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one uint32 array, and the offset of each text's first id (one more at the end).

        A null text counts as empty.
        """
        texts = pc.fill_null(texts, "")
        if not self.chunked:
            ids, sizes = self._alone(texts.to_pylist())
            return ids, np.concatenate(([0], np.cumsum(sizes)))
        # Special tokens keep their case, so texts that may hold one do too.
        special = pc.match_substring(texts, "<|")
        lower = pc.ascii_lower(texts)
        texts = pc.if_else(special, texts, lower) if pc.any(special).as_py() else lower
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten()
        kept = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        ends = np.concatenate(([0], np.cumsum(kept)))[ends - ends[0]]
        chunks = chunks.filter(pa.array(kept)).dictionary_encode()
        pool, sizes = self._chunks(chunks.dictionary)
        starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        taken = pa.ListArray.from_arrays(pa.array(starts), pa.array(pool)).take(chunks.indices)
        offsets = taken.offsets.to_numpy()[ends].astype(np.int64)
        return taken.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]

    def with_end(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As calling it, with the id ``end`` after each text."""
        ids, offsets = self(texts)
        out = np.full(len(ids) + len(texts), end, "<u4")
        lengths = np.diff(offsets)
        offsets = offsets + np.arange(len(offsets))
        out[gather_ranges(offsets[:-1], lengths)] = ids
        return out, offsets


_held: dict[tuple, object] = {}


def give_back() -> None:
    """Return memory that is free to the system; a worker process outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """An Arrow function that gives memory back after each batch."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            give_back()

    return tidied


def held(key: tuple, make: Callable[[], object]):
    """What a worker process remembers from task to task: one thing, the last that was asked for."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Forget what the worker process remembers, for tasks that need none of it."""
    if _held:
        _held.clear()
        give_back()


def encoder(path: str, chunked: bool = True, cached: int = CACHED_CHUNKS) -> TextEncoder:
    """An encoder that lives from task to task, with its cache."""
    key = ("encoder", path, chunked, cached)
    return held(key, lambda: TextEncoder(path, chunked, cached))
