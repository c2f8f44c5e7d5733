"""Near copies by SimHash: fingerprints of shingles, linked at a small Hamming distance.

Close fingerprints are found with vantage-point trees.  A tree over a bounded sample cuts the
space into shards by Hamming distance to vantage points.  By the triangle inequality two fingerprints within
``distance`` of each other differ by at most that in their distance to any point, so a fingerprint goes
to the near side of a node up to ``distance`` beyond its boundary, and to the far side from the
boundary on: every close pair meets in some shard.  Each shard is searched exactly by a tree of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayspark.llm.components import components
from stayspark.llm.joins import sized
from stayspark.llm.tokens import tidy
from stayspark.session import durable

SEED = 42
# Fingerprints on which the shards' tree is fitted, and how many of them a shard must have.
SAMPLE, SAMPLE_PER_SHARD = 262_144, 16
# Distinct fingerprints that a shard is meant to hold; a larger one is searched in blocks.
SHARD, SHARD_LIMIT = 5_000, 4_000_000
# Groups that are compared directly inside a shard.
DIRECT = 256


# Text that is cut into words at a time, and hashes whose bits are counted at a time.
WINDOW_BYTES, HASHES = 1 << 20, 1 << 16


def _windows(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The words of a text in windows, each with the last words of the one before."""
    text = text.lower()  # of bytes: A-Z only; split() knows the same six white-space bytes
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + WINDOW_BYTES
        if end < len(text):
            gap = re.compile(rb"[\x20\x09-\x0D]").search(text, end)
            end = gap.start() if gap else len(text)
        words = carried + text[at:end].split()
        yield words
        carried = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
        at = end


def _digests(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The hashes of all shingles, window by window; a text of fewer words is one shingle."""
    digest = xxhash.xxh64_digest
    some, few = False, []
    for words in _windows(text, shingle):
        if len(words) < shingle:
            few = words
            continue
        some = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(ends) - shingle] + 1))
        spans = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
        yield [digest(joined[a:b], SEED) for a, b in spans]
    if few and not some:
        yield [digest(b" ".join(few), SEED)]


def _fingerprints(shingle: int, into: str = "print", keep_text: bool = False) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            ones = np.zeros((len(texts), 64), np.int64)
            sizes = np.zeros(len(texts), np.int64)
            rows: list[int] = []
            held: list[list[bytes]] = []

            def count() -> None:
                lengths = np.array([len(h) for h in held])
                flat = np.frombuffer(b"".join(d for h in held for d in h), np.uint8)
                bits = np.unpackbits(flat).reshape(-1, 64)
                sums = np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int32)
                np.add.at(ones, rows, sums)
                np.add.at(sizes, rows, lengths)
                rows.clear()
                held.clear()

            waiting = 0
            for row in range(len(texts)):
                for found in _digests(texts[row].as_py(), shingle):
                    rows.append(row)
                    held.append(found)
                    waiting += len(found)
                    if waiting >= HASHES:
                        count()
                        waiting = 0
            if held:
                count()
            packed = np.packbits(2 * ones > sizes[:, None], axis=1)
            prints = packed.view(">i8").ravel().astype("<i8")
            others = [c for c in batch.schema.names if c != "text" or keep_text]
            columns = [*map(batch.column, others), pa.array(prints)]
            yield pa.record_batch(columns, [*others, into])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``print`` (64 bits as a long) of every row of ``docs``.

    Words are what white space separates, A-Z lower-cased; every run of ``shingle`` words, joined by
    single spaces, gives its XXH64 with seed 42.  A bit is 1 if set in over half of these.  Fewer
    words make one shingle; none, as in a null text, give 0.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_fingerprints(shingle)), "doc_id long, print long")


def _away(prints: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(prints ^ point)


def _split(prints: np.ndarray, distance: int, tries: int = 8) -> tuple | None:
    """A vantage point and boundary that part the prints best; None if none parts them."""
    best, least = None, 0.9 * len(prints)
    for at in np.linspace(0, len(prints) - 1, tries).astype(int):
        away = _away(prints, prints[at])
        boundary = int(np.median(away))
        near, far = away <= boundary + distance, away > boundary
        most = max(near.sum(), far.sum())
        if most < least:
            best, least = (prints[at], boundary, near, far), most
    return best


def shard_tree(sample: np.ndarray, distance: int, shards: int) -> list:
    """Nodes ``(point, boundary, near, far)`` from the root; a negative child ``-k - 1`` is shard k."""
    nodes: list = []
    leaves = 0

    def grow(prints: np.ndarray, shards: int) -> int:
        nonlocal leaves
        parts = _split(prints, distance) if shards > 1 and len(prints) > 1 else None
        if parts is None:
            leaves += 1
            return -leaves
        point, boundary, _, far = parts
        at = len(nodes)
        nodes.append(None)
        # The tree is balanced for the sample without what lies beyond a boundary.
        children = grow(prints[~far], shards // 2), grow(prints[far], shards - shards // 2)
        nodes[at] = (point, boundary, *children)
        return at

    grow(np.unique(sample), shards)
    return nodes


def _route(nodes: list, distance: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            waiting = [(0 if nodes else -1, prints)]
            while waiting:
                node, held = waiting.pop()
                if not len(held):
                    continue
                if node < 0:
                    shard = np.full(len(held), -node - 1, np.int32)
                    yield pa.record_batch(
                        [pa.array(shard), pa.array(held.view(np.int64))], ["shard", "print"]
                    )
                    continue
                point, boundary, near, far = nodes[node]
                away = _away(held, point)
                waiting.append((near, held[away <= boundary + distance]))
                waiting.append((far, held[away > boundary]))

    return run


def shard_links(prints: np.ndarray, distance: int) -> np.ndarray:
    """For each print the smallest one that links of at most ``distance`` bits lead to, inside the shard."""
    prints = np.unique(prints)
    parent = np.arange(len(prints))

    def roots(of: np.ndarray) -> np.ndarray:
        while True:
            up = parent[of]
            if (up == of).all():
                return of
            of = up

    def compare(rows: np.ndarray) -> None:
        """All pairs, in blocks; a print is joined with all its partners of a block at once."""
        for a in range(0, len(rows), DIRECT):
            some = rows[a : a + DIRECT]
            for b in range(a, len(rows), 8 * DIRECT):
                others = rows[b : b + 8 * DIRECT]
                close = _away(prints[some][:, None], prints[others][None, :]) <= distance
                for i in np.flatnonzero(close.sum(axis=1) > (a == b)):
                    linked = np.unique(roots(np.append(others[close[i]], some[i])))
                    parent[linked] = linked[0]

    waiting = [np.arange(len(prints))]
    while waiting:
        rows = waiting.pop()
        parts = _split(prints[rows], distance, 3) if len(rows) > DIRECT else None
        if parts is None:
            compare(rows)
        else:
            waiting += [rows[parts[2]], rows[parts[3]]]
    return np.stack([prints, prints[roots(parent)]])


def _search(distance: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        prints = table.column("print").to_numpy().view(np.uint64)
        own, root = shard_links(prints, distance).view(np.int64)
        linked = own != root
        return pa.table({"a": own[linked], "b": root[linked]})

    return run


def links(prints: DataFrame, count: int, distance: int = 2) -> DataFrame:
    """Links ``a``, ``b`` that connect all of the distinct ``print`` values within ``distance`` bits.

    ``count`` is their number.  Linked prints of a shard are tied to one of them, not pair by pair, so a dense
    group gives as many links as it has prints.
    """
    shards = min(-(-count // SHARD), SAMPLE // SAMPLE_PER_SHARD)
    nodes: list = []
    if shards > 1:
        part = F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < int((1 << 30) * min(1, SAMPLE / count))
        sample = prints.select("print").where(part).limit(2 * SAMPLE).toArrow().column("print")
        nodes = shard_tree(sample.to_numpy().view(np.uint64), distance, shards)
    routed = prints.select("print").mapInArrow(_route(nodes, distance), "shard int, print long")
    if count * 2 > SHARD_LIMIT:
        routed = _in_blocks(durable(routed))
    else:
        routed = routed.select("shard", F.lit(0).alias("x"), F.lit(0).alias("y"), "print")
    return routed.groupBy("shard", "x", "y").applyInArrow(_search(distance), "a long, b long")


def _in_blocks(routed: DataFrame) -> DataFrame:
    """Shards beyond the limit as pairs of blocks, which meet all their prints with each other."""
    sizes = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("shard", F.ceil(2 * F.col("size") / SHARD_LIMIT).cast("int").alias("n"))
    # At most one row per shard of the tree, whose number is bounded by the sample.
    blocked = routed.join(F.broadcast(sizes), "shard").withColumn(
        "own", F.pmod(F.xxhash64("print", F.lit(1)), F.col("n")).cast("int")
    )
    other = blocked.withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    return other.select(
        "shard", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "print"
    )


def near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id``, ``print``, ``component_id`` of every row of ``docs``.

    Rows whose prints are at most ``distance`` bits apart are linked; ``component_id`` is the smallest
    id that links lead to, the row's own included (null only where no reachable row has an id).
    Equal rows have equal prints, so repeated rows share a component.  An empty table gives no rows; other
    columns are ignored.
    """
    rows = durable(fingerprints(docs, shingle))
    prints = durable(
        rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    count = prints.count()
    roots = components(links(prints, count, distance))
    members = roots.union(roots.select("root", "root").distinct())
    known = members.toDF("print", "root").join(prints, "print")
    first = known.groupBy("root").agg(F.min("first").alias("component"))
    linked = known.join(first, "root").select("print", "component")
    # Prints of one row that nothing is linked to need no look-up.
    named = durable(
        prints.join(linked, "print", "left")
        .where("rows > 1 OR component IS NOT NULL")
        .select("print", F.coalesce("component", "first").alias("component"))
    )
    return rows.join(sized(named, named.count()), "print", "left").select(
        "doc_id", "print", F.coalesce("component", "doc_id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; all columns unchanged.

    Rows without an id stay, as nothing names them; so do all rows with the id that stays.  Of rows that share an
    id, only those with the fingerprint of a near copy go.
    """
    marked = durable(near_copies(docs, shingle, distance).where("doc_id IS NOT NULL"))
    gone = F.col("component_id") < F.col("doc_id")
    ids = marked.groupBy("doc_id").agg(F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("rows"))
    ids = durable(ids.where("gone > 0").select(F.col("doc_id").alias("_near_id"), (F.col("gone") < F.col("rows")).alias("some")))
    kept = docs.join(sized(ids, ids.count()), docs["doc_id"] == ids["_near_id"], "left_anti")
    shared = ids.where("some").select("_near_id")
    if shared.isEmpty():
        return kept
    # Ids of several rows of which some go: their rows are told apart by their fingerprints.
    name = next(n for n in map("_near_print{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    rows = docs.join(shared, docs["doc_id"] == shared["_near_id"], "left_semi")
    printed = rows.mapInArrow(tidy(_fingerprints(shingle, name, keep_text=True)), schema)
    copies = marked.where(gone).select(F.col("doc_id").alias("_near_id"), "print").distinct()
    same = (printed["doc_id"] == copies["_near_id"]) & (printed[name] == copies["print"])
    return kept.unionByName(printed.join(copies, same, "left_anti").select(*docs.columns))
