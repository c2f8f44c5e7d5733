"""Exact top-k by inner product as a Voronoi join.

Vectors are grouped by the nearest of a few pivots.  Per group of queries a bound follows from
summaries: the k-th best score of each query among a bounded sample of the data is one that its
result cannot fall below.  A data vector goes to a group of queries only if it can still reach the
lowest of these bounds: its score with a query is at most its score with the query's pivot plus its length
times the query's distance from that pivot.  Each pair of a query group and a part of the data is
solved locally, and only scores that reach their query's bound travel to the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayspark.session import durable

PIVOTS = 256
SAMPLE = 4096
# Queries that are solved together, and data vectors that they are held against at a time.
GROUP, PART = 2048, 8192
# Query groups whose bounds are broadcast; beyond it groups grow instead.
GROUPS = 4096
# Components up to this size give inner products that fit into a long, for any usual dimension.
LARGEST = 2**24
# Where components are beyond it, bounds are found on vectors scaled down, as squares would be no finite doubles.
FINITE = 2.0**500
# Rounding of an inner product of doubles, as a share of the product of the lengths, for each dimension.
ROUNDING = 2.0**-50


def integer_vectors(embedding: Column, scale: int = 64, largest: float | None = None) -> Column:
    """floor(scale * x) of every component, as doubles; null for a vector that takes no part.

    That is one that is null or holds a component that is null or not finite; or beyond ``largest``, where it is given.
    """

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        # From 2**53 on doubles are whole; floor would stop at the largest long.
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    def wrong(x: Column) -> Column:
        size = F.abs(x.cast("double"))
        beyond = size == float("inf") if largest is None else size * scale > largest
        return x.isNull() | F.isnan(x) | beyond

    odd = F.coalesce(F.exists(embedding, wrong), F.lit(False))
    return F.when(embedding.isNotNull() & ~odd, F.transform(embedding, whole))


def _matrix(vectors: pa.Array, width: int, shift: int = 0) -> np.ndarray:
    """Vectors as rows, divided by ``2 ** shift``; shorter ones count as filled up with zeros."""
    out = np.zeros((len(vectors), width))
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    if not np.isfinite(out).all():
        raise ValueError("a component is not a finite number")
    return np.ldexp(out, -shift) if shift else out


def _column(batch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _most(a: np.ndarray, b: np.ndarray) -> float:
    """What no inner product, and no part of its sum, is beyond; infinite where doubles end."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products that fit a long: in doubles where these hold them, else in longs."""
    if _most(a, b) < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1))


def _rounding(a: np.ndarray, b: np.ndarray, shift: int = 0) -> np.ndarray:
    """How far each inner product in doubles may be from the exact one; 0 where doubles hold it."""
    width = a.shape[1]
    if shift:  # products of scaled vectors may also be too small for a double
        return _lengths(a)[:, None] * _lengths(b)[None, :] * (ROUNDING * (width + 2)) + width * 2.0**-600
    held = np.abs(a).max(axis=1)[:, None] * np.abs(b).max(axis=1)[None, :] * width < 2**53
    off = _lengths(a)[:, None] * _lengths(b)[None, :] * (ROUNDING * (width + 2))
    return np.where(held, 0.0, off)


def _wide(
    query: np.ndarray, own: int, bound: float, near: np.ndarray, keys: np.ndarray, begins: np.ndarray, k: int, shift: int
):
    """The ``k`` best of ``near`` for one query, where scores may not fit a long: ids and whole scores.

    Scores in doubles, with what they may be off by, leave few rows; only these are summed as whole numbers.
    """
    small = [np.ldexp(x, -shift) if shift else x for x in (query, near)]
    score, off = (small[1] @ small[0]), _rounding(small[0][None, :], small[1], shift)[0]
    low = np.maximum.reduceat(score - off, begins)
    low[keys == own] = -np.inf
    least = np.partition(low, -k)[-k] if len(low) >= k else -np.inf
    of = np.searchsorted(begins, np.arange(len(near)), side="right") - 1
    rows = np.flatnonzero((score + off >= max(least, bound)) & (keys[of] != own))
    # Equal vectors, of which there may be many, are summed once.
    same, which = np.unique(near[rows], axis=0, return_inverse=True)
    whole = [int(x) for x in query]
    sums = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in same]
    best: dict[int, int] = {}
    for key, at in zip(keys[of[rows]].tolist(), which.ravel().tolist(), strict=True):
        best[key] = max(best.get(key, sums[at]), sums[at])
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and the distance to it, rounded up a little."""
    sizes = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :]
    square = sizes - 2 * x @ pivots.T
    cell = square.argmin(axis=1)
    at = np.arange(len(x)), cell
    # Where large parts cancel out, what is left of the square is no better than their rounding.
    off = sizes[at] * (ROUNDING * (x.shape[1] + 4))
    away = np.sqrt(np.maximum(square[at], 0) + off)
    return cell, away * (1 + 1e-9) + 1e-6


def _bounds(pivots: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int, shift: int):
    """For each query its cell, its distance to the pivot, and the k-th best score in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column("vector"), pivots.shape[1], shift), batch.column("id").to_numpy()
            cell, away = _nearest(x, pivots)
            bound = np.full(len(x), -np.inf)
            for a in range(0, len(x), GROUP):
                some = x[a : a + GROUP]
                score = some @ sample.T
                if shift or _most(some, sample) >= 2**53:
                    score -= _rounding(some, sample, shift)
                score[own[a : a + GROUP, None] == ids[None, :]] = -np.inf
                if score.shape[1] >= k:
                    least = np.partition(score, -k, axis=1)[:, -k]
                    # A little below, so that rounding of a large score cannot cut it off.
                    bound[a : a + GROUP] = least - np.abs(least) * 1e-12 - 1
            columns = [batch.column("id"), batch.column("vector"), pa.array(cell), pa.array(away), pa.array(bound)]
            yield pa.record_batch(columns, ["id", "vector", "cell", "away", "bound"])

    return run


def _replicate(pivots: np.ndarray, cells: list[tuple[int, int, float, int]], parts: int, shift: int):
    """Each data vector once for every query group that it may matter to.

    ``cells`` has a query group, one of its cells, that cell's largest distance and the group's bound.
    """
    group, cell, away, bound = (np.array(c) for c in zip(*cells, strict=True))
    lengths = _lengths(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            for a in range(0, len(vectors), GROUP):
                some = batch.slice(a, GROUP)
                x = _matrix(some.column("vector"), pivots.shape[1], shift)
                size = _lengths(x)[:, None]
                reach = (x @ pivots.T)[:, cell] + size * away[None, :]
                off = size * (lengths[cell] + away)[None, :] * (ROUNDING * (x.shape[1] + 4))
                reach = reach + np.abs(reach) * 1e-9 + off + 1e-6
                for g in np.unique(group):
                    of = group == g
                    rows = np.flatnonzero((reach[:, of] >= bound[of][None, :]).any(axis=1))
                    if not len(rows):
                        continue
                    part = some.take(pa.array(rows))
                    spread = part.column("id").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    number = ((spread >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
                    yield pa.record_batch(
                        [pa.array(np.full(len(rows), g, np.int32)), pa.array(number), *part.columns],
                        ["grp", "part", "id", "vector"],
                    )

    return run


def _longs(best: list[tuple[int, int]]) -> tuple[np.ndarray, np.ma.MaskedArray]:
    """Ids and scores; a score below all longs is masked, as better ones may push it out; one above is an error."""
    if any(score >= 2**63 for _, score in best):
        raise ValueError("a score does not fit a long")
    below = [score < -(2**63) for _, score in best]
    scores = [0 if b else score for b, (_, score) in zip(below, best, strict=True)]
    keys = np.array([key for key, _ in best], np.int64)
    return keys, np.ma.array(np.array(scores, np.int64), mask=np.array(below, bool))


def _solve(width: int, k: int, shift: int):
    """The best of a part of the data for each query of a group, where they reach the query's bound."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        own, bound = (_column(queries, c).to_numpy() for c in ("id", "bound"))
        ids = _column(data, "id").to_numpy()
        order = np.argsort(ids, kind="stable")
        # Rows of one id are in one part; they count as one candidate.
        ids, firsts = np.unique(ids[order], return_index=True)
        ends = np.append(firsts[1:], len(order))
        q = _matrix(_column(queries, "vector"), width)
        x = _matrix(_column(data, "vector"), width)[order]
        out: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(ids), PART):
            keys, begins = ids[a : a + PART], firsts[a : a + PART]
            near = x[begins[0] : ends[a : a + PART][-1]]
            if _most(q, near) >= 2**63:
                for row in range(len(q)):
                    best = _wide(q[row], own[row], bound[row], near, keys, begins - begins[0], k, shift)
                    out.append((np.full(len(best), own[row]), *_longs(best)))
                continue
            score = _product(q, near).astype(np.int64)
            if len(near) > len(keys):
                score = np.maximum.reduceat(score, begins - begins[0], axis=1)
            score[own[:, None] == keys[None, :]] = -(2**63)
            for row in range(len(q)):
                s = score[row]
                at = np.flatnonzero(s >= np.ldexp(bound[row], 2 * shift))
                if len(at) > k:
                    least = np.partition(s[at], -k)[-k]
                    more, ties = at[s[at] > least], at[s[at] == least]
                    at = np.concatenate((more, ties[: k - len(more)]))  # ids stand in order
                at = at[s[at] > -(2**63)]
                out.append((np.full(len(at), own[row]), keys[at], np.ma.array(s[at], mask=False)))
        columns = [np.ma.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c.data, pa.int64(), mask=np.ma.getmaskarray(c)) for c in columns], schema=schema)

    return run


def top_k(queries: DataFrame, data: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest scores of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Both sides have ``id`` and ``vector`` (whole numbers, as ``integer_vectors`` gives them; rows with a null take no
    part).  The score is the inner product; a shorter vector counts as filled up with zeros.  A row
    with the query's own id is no candidate.  Ties go to the smaller id; with fewer candidates all are returned.
    An id that has several rows counts once per query, with its best score; repeated rows change nothing.
    Empty sides give no rows.  Scores are exact at every size; one among the best that does not fit a long is an error.
    """
    spark = data.sparkSession
    clean = [
        durable(side.select(F.col("id").cast("long"), F.col("vector").cast("array<double>").alias("vector")).dropna())
        for side in (queries, data)
    ]
    count, width = clean[1].agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    asked, wide = clean[0].agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count or not asked:
        return spark.createDataFrame([], schema)
    width = max(width, wide, 1)
    largest = max(
        side.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).first()[0] for side in clean
    )
    shift = math.frexp(largest)[1] - 400 if largest >= FINITE else 0
    # Spread over the data by a hash: rows that are everywhere the same in number, whatever the size.
    picked = clean[1].orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    _, at = np.unique(_column(picked, "id").to_numpy(), return_index=True)
    sample = _matrix(_column(picked, "vector"), width, shift)[np.sort(at)]
    pivots = np.unique(sample[:PIVOTS], axis=0)
    bounds = _bounds(pivots, _column(picked, "id").to_numpy()[np.sort(at)], sample, k, shift)
    known = durable(
        clean[0].mapInArrow(
            bounds, "id long, vector array<double>, cell long, away double, bound double"
        )
    )
    # Cells of queries side by side make groups; a large cell is dealt out over several.
    size = max(GROUP, -(-asked // GROUPS))
    cells = known.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    first = 0
    starts = []
    for r in cells:
        starts.append((r["cell"], first, max(1, -(-r["n"] // size)), r["n"]))
        first += r["n"]
    table = spark.createDataFrame(starts, "cell long, first long, split long, n long")
    # At most one row per pivot.
    within = F.pmod(F.xxhash64("id"), F.col("n"))
    grouped = known.join(F.broadcast(table), "cell").withColumn(
        "grp", F.floor((F.col("first") + within) / size).cast("int")
    )
    grouped = durable(grouped.select("grp", "id", "vector", "cell", "away", "bound"))
    summary = grouped.groupBy("grp", "cell").agg(F.max("away").alias("away"), F.min("bound").alias("bound"))
    low = summary.withColumn("bound", F.min("bound").over(W.partitionBy("grp"))).collect()
    parts = -(-count // PART)
    copies = clean[1].mapInArrow(
        _replicate(pivots, [(r["grp"], r["cell"], r["away"], r["bound"]) for r in low], parts, shift),
        "grp int, part int, id long, vector array<double>",
    )
    spread = grouped.withColumn("part", F.explode(F.expr(f"sequence(0, {parts - 1})")))
    pairs = (
        spread.select("grp", "part", "id", "vector", "bound")
        .groupBy("grp", "part")
        .cogroup(copies.groupBy("grp", "part"))
        .applyInArrow(_solve(width, k, shift), "query_id long, vec_id long, score long")
    )
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # A score below all longs has none.
    wrong = F.raise_error(F.lit("a score does not fit a long")).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.coalesce("score", wrong).alias("score"))
