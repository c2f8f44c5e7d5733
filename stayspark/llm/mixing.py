"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source stand one after the other, documents in ascending id order, and are cut into
blocks of a fixed length.  Output shards have a fixed number of slots.  Each shard draws how many
of its slots go to which source from a multinomial; a source's k-th slot takes the block at place k of
a pseudorandom permutation of its blocks (a new one for each further pass), and blocks are joined by
their index.  All draws are functions of the seed, the source and the shard, so reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.llm.joins import sized
from stayspark.llm.tokens import let_go
from stayspark.session import durable

# Sources among which slots are drawn at a time, and shards that a task draws them for.
CHUNK, SHARDS = 4096, 512


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, null last, over and over.

    ``share`` of all words are to be taken, no source more than ``most`` times.  Any number of sources is
    mixed; where ``sources`` is given, more of them are an error.
    """

    weights: Sequence[float] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    block_words: int = 256
    shard_slots: int = 16_384
    seed: int = 42
    sources: int | None = None


def n_words(text: Column) -> Column:
    """Runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: dict, mix: Mix) -> dict:
    """Words to take of each source: by weight, stopped at ``most`` times its size.

    What stops is shared out again by weight among the others, until none is above.  ``_with_targets``
    does the same in Spark; this is for lists that are at hand.
    """
    ordered = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(mix.weights[i % len(mix.weights)]) for i, s in enumerate(ordered)}
    rest = mix.share * sum(sizes.values())
    found, open_ = {}, list(ordered)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total if total else 0.0 for s in open_}
        above = [s for s in open_ if share[s] > mix.most * sizes[s]]
        if not above:
            return found | share
        for s in above:
            found[s] = float(mix.most * sizes[s])
        rest -= sum(found[s] for s in above)
        open_ = [s for s in open_ if s not in found]
    return found


def source_slots(number: int, size: int, need: int, mix: Mix) -> tuple[int, int, int]:
    """How many blocks and slots a source has and what its last slot takes (0: all of its block)."""
    blocks = -(-size // mix.block_words)
    whole, rest = divmod(need, size)
    slots, last = whole * blocks, 0
    if rest:
        # All blocks are full but for the last one; where does this pass take that?
        short = size - (blocks - 1) * mix.block_words
        at = int(unpermuted(np.array([blocks - 1]), blocks, key(mix, number, whole))[0])
        used = -(-rest // mix.block_words)
        lacks = mix.block_words - short
        if at < used:
            used += rest > used * mix.block_words - lacks
            # With the short block among the slots, one of them may not be needed after all.
        held = (used - 1) * mix.block_words - (lacks if at < used - 1 else 0)
        slots, last = slots + used, rest - held
    return blocks, slots, last


def _plan(sources: DataFrame, mix: Mix) -> DataFrame:
    """``source_no``, ``size``, ``blocks``, ``slots``, ``last`` of every source that words are taken of."""

    def run(batches):
        for batch in batches:
            rows = [
                (number, size, *source_slots(number, size, need, mix))
                for number, size, need in batch.itertuples(index=False, name=None)
            ]
            yield pd.DataFrame(rows, columns=["source_no", "size", "blocks", "slots", "last"])

    needed = sources.select("source_no", "source_size", F.col("target").cast("long").alias("need"))
    return needed.where("need > 0").mapInPandas(
        run, "source_no long, size long, blocks long, slots long, last long"
    )


def key(mix: Mix, source_no: int, number: int) -> int:
    """The key of a source's permutation in one pass."""
    return int(np.random.SeedSequence([mix.seed, source_no, number]).generate_state(1, np.uint64)[0])


def _round(half: np.ndarray, turn: int, secret: np.uint64, mask: np.uint64) -> np.ndarray:
    """Pseudorandom bits from half of an index."""
    mixed = (half + secret) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) & mask


def _walk(index: np.ndarray, count: int, secret: int, turns: list[int]) -> np.ndarray:
    """Feistel rounds on the smallest even number of bits, again for what falls outside ``count``."""
    bits = np.uint64(max(1, -(-max(count - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(bits)) - 1)
    secret = np.uint64(secret)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    backward = turns[0] > turns[-1]
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for turn in turns:
            if backward:
                left, right = right ^ _round(left, turn, secret, mask), left
            else:
                left, right = right, left ^ _round(right, turn, secret, mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def permuted(index: np.ndarray, count: int, secret: int) -> np.ndarray:
    """Where a pseudorandom permutation of ``count`` places takes each index."""
    return _walk(index, count, secret, [0, 1, 2, 3])


def unpermuted(index: np.ndarray, count: int, secret: int) -> np.ndarray:
    """The indices that ``permuted`` takes to these places."""
    return _walk(index, count, secret, [3, 2, 1, 0])


def _in_order(docs: DataFrame) -> DataFrame:
    """Documents with the words that stand before them in their source, without one long window."""

    def place(batches):
        let_go()
        part, last, words = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            number, size = batch["source_no"].to_numpy(), batch["size"].to_numpy()
            ends = np.cumsum(size)
            # Sources stand one after the other; the first may go on from the batch before.
            firsts = np.flatnonzero(np.diff(number, prepend=-1))
            runs = np.diff(np.append(firsts, len(number)))
            offset = (ends - size)[firsts]
            if len(firsts) and number[0] == last:
                offset[0] -= words
            start = ends - size - np.repeat(offset, runs)
            if len(firsts):
                last, words = int(number[-1]), int(start[-1] + size[-1])
            yield batch.assign(part=part, start=start)

    order = ["source_no", "doc_id", "twin"]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "doc_id long, size long, twin long, source_no long, part int, start long"
    placed = durable(dealt.select("doc_id", "size", "twin", "source_no").mapInPandas(place, schema))
    # One row per task and source that it holds.
    sums = placed.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    earlier = durable(
        sums.selectExpr(
            "source_no",
            "part",
            "sum(words) OVER (PARTITION BY source_no ORDER BY part) - words AS earlier",
        )
    )
    joined = placed.join(sized(earlier, earlier.count()), ["source_no", "part"])
    return joined.select(
        "doc_id", "twin", "source_no", "size", (F.col("start") + F.col("earlier")).alias("start")
    )


def _draws(spark, plan: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """``shard``, ``source_no``, ``drawn`` where a shard draws slots of a source; and the number of shards.

    A shard's slots are drawn first among chunks of sources, then among the sources of a chunk, which
    together is one multinomial draw among all sources.
    """
    chunk = F.expr(f"source_no div {CHUNK}").alias("chunk")
    chunks = plan.groupBy(chunk).agg(F.sum("slots").alias("slots")).orderBy("chunk").collect()
    numbers = np.array([c["chunk"] for c in chunks], np.int64)
    slots = sum(c["slots"] for c in chunks)
    shards = -(-slots // mix.shard_slots)
    share = np.array([c["slots"] for c in chunks], float) / slots

    def among_chunks(batches):
        for batch in batches:
            for shard in batch["id"]:
                drawn = np.random.default_rng([mix.seed, int(shard)]).multinomial(mix.shard_slots, share)
                some = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": int(shard), "chunk": numbers[some], "drawn": drawn[some]})

    def among_sources(drawn: pa.Table, sources: pa.Table) -> pa.Table:
        number, slots = (sources.column(c).to_numpy() for c in ("source_no", "slots"))
        order = np.argsort(number)
        number, part = number[order], slots[order] / max(slots.sum(), 1)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for row in drawn.to_pylist():
            # Chunks count from 1: a missing number would stand for 0.
            seed = [mix.seed, row["shard"], row["chunk"] + 1]
            drawn_of = np.random.default_rng(seed).multinomial(row["drawn"], part)
            some = np.flatnonzero(drawn_of)
            values = np.full(len(some), row["shard"]), number[some], drawn_of[some]
            for column, value in zip(found, values, strict=True):
                column.append(value)
        return pa.table([np.concatenate(c) for c in found], ["shard", "source_no", "drawn"])

    by_chunk = spark.range(0, shards, 1, min(shards, 200)).mapInPandas(
        among_chunks, "shard long, chunk long, drawn long"
    )
    group = ["chunk", "bunch"]
    by_chunk = by_chunk.withColumn("bunch", F.expr(f"shard div {SHARDS}"))
    bunches = F.explode(F.expr(f"sequence(0L, {(shards - 1) // SHARDS}L)"))
    sources = plan.select("source_no", "slots", chunk, bunches.alias("bunch"))
    drawn = (
        by_chunk.groupBy(*group)
        .cogroup(sources.groupBy(*group))
        .applyInArrow(among_sources, "shard long, source_no long, drawn long")
    )
    return durable(drawn), shards


def _slots(spark, plan: DataFrame, planned: int, mix: Mix) -> DataFrame:
    """``source_no``, ``block``, ``pass``, ``shard``, ``slot``, ``words`` of every slot of the mix.

    ``slot`` counts a source's slots, ``words`` how many of its block's a slot takes: all, but in the last.
    Slots drawn beyond a source's need are left out, and what the draws leave short is in one more
    shard, so each source gets exactly the words of its target.  ``planned`` is the number of rows of ``plan``.
    """

    def look_up(batches):
        for batch in batches:
            block = np.zeros(len(batch), np.int64)
            for (number, turn, blocks), rows in batch.groupby(["source_no", "pass", "blocks"]).indices.items():
                at = batch["slot"].to_numpy()[rows] - turn * blocks
                block[rows] = permuted(at, int(blocks), key(mix, int(number), int(turn)))
            yield batch.assign(block=block)

    columns = ["source_no", "size", "blocks", "slots", "last"]
    table = sized(plan, planned)
    drawn, shards = _draws(spark, plan, mix)
    drawn = drawn.selectExpr(
        "*", "sum(drawn) OVER (PARTITION BY source_no ORDER BY shard) - drawn AS first"
    )
    sums = drawn.groupBy("source_no").agg(F.sum("drawn").alias("first"))
    short = (
        plan.join(sized(sums, planned), "source_no", "left")
        .withColumn("first", F.coalesce("first", F.lit(0)))
        .where("first < slots")
        .selectExpr(f"CAST({shards} AS BIGINT) AS shard", "source_no", "slots - first AS drawn", "first")
    )
    runs = drawn.union(short.select("shard", "source_no", "drawn", "first")).join(table, "source_no")
    slots = (
        runs.where("drawn > 0 AND first < slots")
        .withColumn("slot", F.expr("explode(sequence(first, least(first + drawn, slots) - 1))"))
        .withColumn("pass", F.expr("slot div blocks"))
    )
    schema = (
        "source_no long, size long, blocks long, slots long, last long, shard long, "
        "slot long, pass long, block long"
    )
    kept = slots.select(*columns, "shard", "slot", "pass")
    length = f"least({mix.block_words}, size - block * {mix.block_words})"
    cut = f"CASE WHEN slot = slots - 1 AND last > 0 THEN last ELSE {length} END AS words"
    return kept.mapInPandas(look_up, schema).selectExpr(
        "source_no", "block", "pass", "shard", "slot", cut
    )


def _sized(docs: DataFrame) -> DataFrame:
    """The rows as id, source, size and hash of the text."""
    return durable(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            n_words(F.col("text").cast("string")).alias("size"),
            F.xxhash64(F.col("text").cast("string")).alias("twin"),
        )
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``source_no``: sources in code point order, null last, from 0 on."""

    def place(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(before, before + len(batch)))
            before += len(batch)
            columns = [*batch.columns, pa.array(np.full(len(batch), part, np.int32)), at]
            yield pa.record_batch(columns, ["source", "source_size", "part", "at"])

    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    dealt = sums.repartitionByRange(order).sortWithinPartitions(order)
    placed = durable(dealt.mapInArrow(place, "source string, source_size long, part int, at long"))
    # One row per task.
    parts, earlier = [], 0
    for part in placed.groupBy("part").count().orderBy("part").collect():
        parts.append((part["part"], earlier))
        earlier += part["count"]
    table = rows.sparkSession.createDataFrame(parts, "part int, earlier long")
    return placed.join(F.broadcast(table), "part").select(
        "source", "source_size", (F.col("earlier") + F.col("at")).alias("source_no")
    )


def _with_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources`` with ``target``, as ``targets`` has it: one aggregate for each round of sharing out."""
    weights = [float(w) for w in mix.weights]
    place = F.pmod("source_no", F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    cap = (F.col("source_size") * F.lit(mix.most)).cast("double")
    closed, stopped = F.lit(False), -1
    while True:
        # Sizes are summed as longs by weight, so neither order nor partitions show in the sums.
        sums = sources.groupBy(place.alias("place")).agg(
            F.sum("source_size").alias("size"),
            F.coalesce(F.sum(F.when(closed, F.col("source_size"))), F.lit(0)).alias("closed_size"),
            F.count(F.when(closed, 1)).alias("closed"),
            F.count(F.when(~closed, 1)).alias("open"),
        )
        found = sums.orderBy("place").collect()
        before, stopped = stopped, sum(r["closed"] for r in found)
        if stopped <= before:
            return sources.withColumn("target", F.when(closed, cap).otherwise(share))
        rest = mix.share * sum(r["size"] for r in found) - mix.most * sum(r["closed_size"] for r in found)
        total = sum(weights[r["place"]] * r["open"] for r in found)
        share = F.lit(float(rest)) * weight / F.lit(total) if total else F.lit(0.0)
        # A share only grows, so what stopped once is above in each further round.
        closed = share > cap if total else closed


def mix_spans(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The documents in their sources, and the spans of them that the mix takes.

    Documents: ``doc_id``, ``source``, ``twin`` (hash of the text), ``source_no``, ``size`` in words, ``start`` in
    the source, ``source_size``, ``target``; one row per row of ``docs``.  Spans: ``shard`` and
    ``slot``, then ``source_no`` and ``start`` of the document, the ``pass`` over the source, ``first``
    (words of the document before the span) and ``words``.

    No source has more words taken than its target, and none fewer than that rounded down; no
    document more than ``mix.most`` times its size.  Null text has no words; a null source is a source, the
    last; a repeated row is a document of its own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = _sized(docs)
    numbered = durable(_numbered(rows))
    count = numbered.count()
    if mix.sources is not None and count > mix.sources:
        raise ValueError(f"more than {mix.sources} sources")
    sources = durable(_with_targets(numbered, mix))
    names = sources.select("source_no", F.col("source").alias("name"))
    known = rows.join(sized(names, count), F.col("source").eqNullSafe(F.col("name")))
    placed = durable(_in_order(known).join(sized(sources, count), "source_no"))
    plan = durable(_plan(sources, mix))
    planned = plan.count()
    if not planned:
        none = "shard long, slot long, source_no long, start long, pass long, first long, words long"
        return placed, spark.createDataFrame([], none)
    size = mix.block_words
    blocks = f"explode(sequence(start div {size}, (start + size - 1) div {size}))"
    pieces = placed.where("size > 0").select("source_no", "start", "size", F.expr(blocks).alias("block"))
    taken = _slots(spark, plan, planned, mix).selectExpr(
        "*", f"block * {size} AS begins", f"block * {size} + words AS ends"
    )
    spans = (
        pieces.join(taken, ["source_no", "block"])
        .withColumn("from", F.greatest("start", "begins"))
        .withColumn("to", F.least(F.col("start") + F.col("size"), F.col("ends")))
        .where("to > from")
    )
    return placed, spans.selectExpr(
        "shard", "slot", "source_no", "start", "pass", "from - start AS first", "to - from AS words"
    )


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs``."""
    placed, spans = mix_spans(docs, mix)
    taken = spans.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    # Documents without words share their start with the next one.
    key_ = ["source_no", "start"]
    joined = placed.join(taken, key_, "left")
    words = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", words.cast("long").alias("taken"))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_text(text: str, first: int, words: int) -> str:
    """``words`` words from the ``first`` on, with the white space between them."""
    begin = end = 0
    for number, found in enumerate(WORD.finditer(text)):
        if number == first:
            begin = found.start()
        if number == first + words - 1:
            end = found.end()
            break
    return text[begin:end]


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each stretch of a document that a pass takes.

    A stretch is a run of words without a gap, so a document that is taken whole keeps its text, and one
    that is taken twice gives two rows.  ``n_chars``, if there, follows the text.  Documents that the mix
    leaves out, and those without words, give no rows.  Of rows repeated with id, source and text, each has its share,
    and other columns are those of one of them.
    """
    placed, spans = mix_spans(docs, mix)
    lists = spans.groupBy("source_no", "start", "pass").agg(
        # The pieces of one document in one pass, which share no word.
        F.sort_array(F.collect_list(F.struct("first", "words"))).alias("pieces"),
        F.sum("words").alias("words"),
    )
    taken = (
        placed.where("size > 0")
        .join(lists, ["source_no", "start"])
        .select(
            F.col("doc_id").alias("_mix_id"),
            F.col("source").alias("_mix_source"),
            F.col("twin").alias("_mix_twin"),
            F.when(F.col("words") < F.col("size"), F.col("pieces")).alias("_mix_pieces"),
        )
    )
    twin = F.xxhash64(F.col("text").cast("string"))
    rows = docs.withColumn("_mix_twin", twin).where(F.col("text").isNotNull())
    same_rows = placed.groupBy("doc_id", "source", "twin").agg(F.count(F.lit(1)).alias("rows"))
    if same_rows.where("rows > 1").limit(1).count():
        # Each of the repeated rows has its share already.
        rows = rows.dropDuplicates(["doc_id", "source", "_mix_twin"])
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_mix_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))
        & (rows["_mix_twin"] == taken["_mix_twin"])
    )
    joined = rows.join(taken, same).select(*[rows[f"`{c}`"] for c in docs.columns], "_mix_pieces")
    # Texts that are taken whole stay where they are; the others reach a worker a few rows at a time.
    some = F.col("_mix_pieces").isNotNull()
    cut = F.udf(cut_texts, "array<string>", useArrow=False)
    cuts = cut(F.when(some, F.col("text").cast("string")), "_mix_pieces")
    stretches = F.when(some, cuts).otherwise(F.array(F.col("text").cast("string")))
    out = joined.withColumn("_mix_text", F.explode(stretches))
    kinds = {field.name: field.dataType for field in docs.schema}
    made = {"text": F.col("_mix_text"), "n_chars": F.char_length("_mix_text")}
    return out.select(
        *[made[c].cast(kinds[c]).alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns]
    )


def cut_texts(text: str | None, pieces: list | None) -> list[str] | None:
    """The stretches of a text that its pieces make; null where there are no pieces."""
    let_go()
    if pieces is None:
        return None
    return [cut_text(text, first, words) for first, words in merged(pieces)]


def merged(pieces: list[dict]) -> list[tuple[int, int]]:
    """Pieces in order, those without a gap between them as one."""
    runs: list[list[int]] = []
    for piece in pieces:
        if runs and runs[-1][0] + runs[-1][1] == piece["first"]:
            runs[-1][1] += piece["words"]
        else:
            runs.append([piece["first"], piece["words"]])
    return [(first, words) for first, words in runs]
