"""The trie of shared beginnings of conversations, measured by an Euler tour.

Conversations that begin with the same turns share the nodes of those turns.  A node is found by a key that adds
up over the turns of a beginning, and is named by its smallest member and its depth.  The tour enters and
leaves every node once, children in the order of their smallest members; each arc knows the one before it.  Ranking that
list gives prefix sums at the arcs, and what lies between the two arcs of a node is its subtree.

The nodes with one smallest member lie on a path, whose arcs mostly follow one another in the tour; such
runs are added up first, so that the list to be ranked is one of runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.llm.list_rank import prefix_sums
from stayspark.operators.scans import running
from stayspark.session import durable

# A key is this many sums of 32-bit parts of hashes: 128 bits, which do not overflow.
PARTS = 4
KEY = [f"k{i}" for i in range(PARTS)]
ABOVE = [f"u{i}" for i in range(PARTS)]
# Ids of conversations that are joined to one text before a checksum takes them.
PIECE = 4096
SUMS = ["place", "leaves", "saved"]


def placed_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` from 0, ``digest`` of role and text, ``tokens`` (code points of the text) of every turn.

    Turns stand by ``turn``, null first, equal ones by their digest.  A null role or text is empty; rows without
    ``conv_id`` are of no conversation and go; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(role).cast("string")
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.unhex(F.sha2(F.concat(size, F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("tokens"),
    )
    order = ["turn", "digest"]
    ranked = running(durable(rows), ["conv_id"], order, {"place": ("sum", F.lit(1).cast("long"))})
    return ranked.select("conv_id", "place", "digest", "tokens")


def _keyed(placed: DataFrame) -> DataFrame:
    """``conv_id, depth, tokens``, the key of every beginning and that of the beginning one turn shorter."""
    salted = F.sha2(F.concat("digest", F.col("place").cast("string").cast("binary")), 256)
    parts = [
        F.conv(F.substring("salted", 8 * i + 1, 8), 16, 10).cast("long").alias(f"p{i}")
        for i in range(PARTS)
    ]
    rows = placed.withColumn("salted", salted).select("conv_id", "place", "tokens", *parts)
    sums = {u: ("sum", F.col(f"p{i}")) for i, u in enumerate(ABOVE)}
    return running(rows, ["conv_id"], ["place"], sums).select(
        "conv_id", (F.col("place") + 1).alias("depth"), "tokens", *ABOVE,
        *[(F.col(u) + F.col(f"p{i}")).alias(k) for i, (u, k) in enumerate(zip(ABOVE, KEY, strict=True))],
    )


def _with_keys(rows: DataFrame, names: list[str], depth: Column, nodes: DataFrame) -> DataFrame:
    """``rows`` and ``found``, the conv_id of the node at ``depth`` whose key ``names`` hold; null where none."""
    known = nodes.select(
        F.col("conv_id").alias("found"), F.col("depth").alias("_depth"),
        *[F.col(k).alias(f"_{k}") for k in KEY],
    )
    same = depth == F.col("_depth")
    for n, k in zip(names, KEY, strict=True):
        same = same & (F.col(n) == F.col(f"_{k}"))
    return rows.join(known, same, "left").select(*rows.columns, "found")


def _tree(keyed: DataFrame, nodes: DataFrame, least: int, count: int) -> DataFrame:
    """All nodes with ``parent_conv_id``, ``previous`` sibling, ``n_children`` and ``last_child``."""
    spark = keyed.sparkSession
    root = spark.range(1).select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(count).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("tokens"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("long").alias("previous"),
    )
    below = _with_keys(nodes, ABOVE, F.col("depth") - 1, nodes).select(
        "conv_id", "depth", "n_convs", "tokens",
        F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("found")).alias("parent_conv_id"),
    )
    below = durable(below)
    families = below.groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count(F.lit(1)).alias("n_children"), F.max("conv_id").alias("last_child"))
    # No two nodes of a depth have a smallest member in common, so siblings stand in one order.
    siblings = running(below, ["parent_conv_id", "depth"], ["conv_id"], {"previous": ("max", F.col("conv_id"))})
    tree = siblings.unionByName(root).join(families, ["conv_id", "depth"], "left")
    return tree.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def _arcs(tree: DataFrame) -> DataFrame:
    """Two arcs per node, each with the one before it in the tour and what it adds to the sums."""

    def arc(conv: Column, depth: Column, leaving: bool) -> Column:
        return F.struct(conv.alias("conv_id"), depth.alias("depth"), F.lit(leaving).alias("leaving"))

    conv, depth, leaf = F.col("conv_id"), F.col("depth"), F.col("n_children") == 0
    entered = (
        F.when(F.col("previous").isNotNull(), arc(F.col("previous"), depth, True))
        .when(depth > 0, arc(F.col("parent_conv_id"), depth - 1, False))
        .otherwise(F.lit(None))
    )
    left = F.when(leaf, arc(conv, depth, False)).otherwise(arc(F.col("last_child"), depth + 1, True))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("tokens")

    def row(leaving: bool, pred: Column, on_path: Column, leaves: Column, saved: Column) -> Column:
        return F.struct(
            F.lit(leaving).alias("leaving"), pred.alias("pred"), on_path.alias("on_path"),
            one.alias("w_place"), leaves.alias("w_leaves"), saved.alias("w_saved"),
        )

    both = F.array(
        row(False, entered, depth, F.when(leaf, one).otherwise(none), saved),
        row(True, left, F.lit(1 << 62) - depth, none, none),
    )
    arcs = tree.select("conv_id", "depth", F.explode(both).alias("arc")).select("conv_id", "depth", "arc.*")
    # A run starts where the tour comes from another path.
    starts = F.col("pred").isNull() | (F.col("pred.conv_id") != F.col("conv_id"))
    return arcs.withColumn("starts", starts.cast("long"))


def _toured(tree: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``entered`` and ``left`` (places of its arcs in the tour), ``n_leaves``, ``saved_tokens``."""
    sums = {"runs": ("sum", F.col("starts"))} | {s: ("sum", F.col(f"w_{s}")) for s in SUMS}
    arcs = durable(
        running(_arcs(tree), ["conv_id"], ["on_path"], sums).withColumn("run", F.col("runs") + F.col("starts"))
    )
    own = F.struct("conv_id", "depth", "leaving")
    runs = arcs.groupBy(F.struct("conv_id", "run").alias("id")).agg(
        F.max(F.when(F.col("starts") == 1, F.col("pred"))).alias("from_arc"),
        F.max_by(own, "on_path").alias("last_arc"),
        *[F.min(s).alias(f"_{s}") for s in SUMS],
        *[(F.max(F.col(s) + F.col(f"w_{s}")) - F.min(s)).alias(s) for s in SUMS],
    )
    runs = durable(runs)
    lasts = runs.select(F.col("last_arc").alias("_arc"), F.col("id").alias("pred"))
    linked = runs.join(lasts, F.col("from_arc") == F.col("_arc"), "left").select("id", "pred", *SUMS)
    ranked = prefix_sums(linked, SUMS).select(
        F.col("id").alias("_id"), *[F.col(s).alias(f"to_{s}") for s in SUMS]
    )
    # Of a run: what comes before its first arc, less what comes before that on its path.
    shifts = durable(
        runs.join(ranked, F.col("id") == F.col("_id")).select(
            "id.conv_id", "id.run",
            *[(F.col(f"to_{s}") - F.col(s) - F.col(f"_{s}")).alias(f"shift_{s}") for s in SUMS],
        )
    )
    at = {s: F.col(s) + F.col(f"shift_{s}") for s in SUMS}

    def between(s: str) -> Column:
        return F.sum(F.when(F.col("leaving"), at[s]).otherwise(-at[s]))

    return arcs.join(shifts, ["conv_id", "run"]).groupBy("conv_id", "depth").agg(
        F.min(at["place"]).alias("entered"), F.max(at["place"]).alias("left"),
        between("leaves").alias("n_leaves"), between("saved").alias("saved_tokens"),
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which follow one another."""
    names = ["conv_id", "depth", "ends_sha256"]
    key, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for conv, depth, piece, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != (conv, depth):
                done += [(*key, digest.hexdigest())] if key else []
                key, digest = (conv, depth), hashlib.sha256()
            digest.update((("," if piece else "") + text).encode())
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names)
    if key:
        yield pa.record_batch([pa.array([c]) for c in (*key, digest.hexdigest())], names)


def _ends(convs: DataFrame, keyed: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """``conv_id``, ``depth``, ``ends_sha256`` of every node at which conversations end."""
    last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("last"))
    last = durable(last.select("conv_id", "last.*"))
    # A join by itself, of which any number of rows may have one key: adaptive execution can split it.
    ended = durable(
        _with_keys(last, KEY, F.col("depth"), nodes).select("conv_id", F.col("found").alias("node"), "depth")
    )
    turnless = convs.join(last, "conv_id", "left_anti").select(
        "conv_id", F.lit(least).cast("long").alias("node"), F.lit(0).cast("long").alias("depth")
    )
    ranked = running(ended.union(turnless), ["node", "depth"], ["conv_id"], {"rank": ("sum", F.lit(1).cast("long"))})
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ranked.groupBy("node", "depth", F.floor(F.col("rank") / PIECE).alias("piece")).agg(
        F.array_join(ids, ",").alias("text")
    )
    dealt = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece")
    return dealt.mapInArrow(_checksums, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(convs: DataFrame, placed: DataFrame) -> DataFrame:
    """The trie of conversations ``convs`` (distinct ``conv_id``) with turns ``placed``, one row per node.

    ``conv_id`` is the smallest member of a node, ``depth`` its number of turns; the root has all conversations, turnless ones
    too.  ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` count members, children, childless nodes of the subtree
    and the tokens that its members share; ``ends_sha256`` is that of the ids of those that end here; ``entered`` and
    ``left`` are the places of a node's arcs in the tour, which enclose those of its subtree.

    Equal beginnings are found by 128 bits of SHA-256 sums.  No conversation, no row.
    """
    found = convs.agg(F.min("conv_id"), F.count("conv_id")).first()
    # Without conversations no node is put out, whatever names the root.
    least, count = found[0] or 0, found[1]
    keyed = durable(_keyed(placed))
    nodes = durable(
        keyed.groupBy("depth", *KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.max("tokens").alias("tokens"), *[F.max(u).alias(u) for u in ABOVE],
        )
    )
    tree = durable(_tree(keyed, nodes, least, count))
    none = F.lit(hashlib.sha256().hexdigest())
    toured = durable(_toured(tree))
    ends = durable(_ends(convs, keyed, nodes, least))
    rows = tree.join(toured, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left").where(F.lit(count) > 0)
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"), "entered", "left",
    )


def trie_of_turns(turns: DataFrame) -> DataFrame:
    """The trie of ``conv_id``, ``turn``, ``role``, ``text`` rows as they are."""
    placed = durable(placed_turns(turns))
    return prefix_trie(placed.select("conv_id").distinct(), placed)


def branched(placed: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches: their ids, and their turns as ``placed_turns`` gives them.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % every`` in place of its own first ``h``, where ``h`` is the
    CRC-32 of ``c`` modulo ``most + 1``; fewer where that one has fewer, none where it is absent.
    """

    def shared(conv: Column) -> Column:
        return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(most + 1))

    convs = durable(placed.select("conv_id").distinct())
    trunk = F.col("conv_id") - F.col("conv_id") % every
    # The first turns of one conversation in ``every``, of which each serves some ``2 * every`` at most.
    trunks = placed.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "trunk")
    sizes = trunks.groupBy("trunk").agg(F.count(F.lit(1)).alias("held"))
    taken = convs.withColumns({"trunk": trunk, "h": shared(F.col("conv_id"))}).join(trunks, "trunk").where("place < h")
    own = placed.withColumns({"trunk": trunk, "h": shared(F.col("conv_id"))}).where("place >= h").join(sizes, "trunk", "left")
    start = F.least("h", F.coalesce("held", F.lit(0)))
    rows = taken.select("conv_id", "place", "digest", "tokens").union(
        own.select("conv_id", (F.col("place") - F.col("h") + start).alias("place"), "digest", "tokens")
    )
    return convs, durable(rows)
