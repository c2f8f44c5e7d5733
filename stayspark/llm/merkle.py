"""A Merkle tree over the rows of a dataset, with an inclusion proof for every row.

Rows become leaves, ranked per group; each group is a binary tree, and the groups' roots are the leaves
of one more.  Trees are built bottom-up in blocks of ``2 ** BITS`` consecutive nodes: the rank inside a block is cut into
binary digits, which are grouped away one after the other, every group nesting its two child structs.  What is left of a
block is one nested struct, and its top is a node of the next level of blocks.

On the way down, each block meets the path above its top in one aggregation, and is
transformed and exploded into the paths of its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.operators.scans import running
from stayspark.session import durable

# Digits of a rank that are grouped away inside a block, which holds up to 2 ** BITS nodes.
BITS = 8
STEP = "struct<before:boolean,sibling:string>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**replaced: Column) -> Column:
    """SHA-256 over all columns of a document, some of them replaced."""
    return F.sha2(F.concat(*[field(replaced.get(c, F.col(c))) for c in COLUMNS]), 256)


def combine(hashes: Column) -> Column:
    """The hash of a run of nodes: SHA-256 of their digests as hex text."""
    return F.sha2(F.array_join(hashes, ""), 256)


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 0 inside ``tree``, and ``levels``, the height of its tree."""
    ranked = running(rows, [tree], order, {"rank": ("sum", F.lit(1).cast("long"))})
    sizes = rows.groupBy(F.col(tree).alias("_tree")).agg(F.count(F.lit(1)).alias("_size"))
    last = F.col("_size") - 1
    levels = F.when(last > 0, F.length(F.bin(last))).otherwise(0)
    return ranked.join(sizes, F.col(tree).eqNullSafe(F.col("_tree"))).select(
        *ranked.columns, levels.alias("levels")
    )


def _blocks(nodes: DataFrame, level: int, bits: int) -> DataFrame:
    """Nodes ``tree, levels, rank, node`` of ``level`` rolled up to one nested ``node`` per block, with its rank.

    A block holds the nodes whose ranks agree but for ``bits`` binary digits.

    ``node`` is a struct whose first field is ``hash``.  A tree that has ended already passes its root on.
    """
    digits = [F.shiftright("rank", k).bitwiseAND(1).alias(f"d{k}") for k in range(bits)]
    # Dealt out once: grouping by more columns keeps the blocks where they are.
    rows = nodes.select(
        "tree", "levels", F.shiftright("rank", bits).alias("block"), *digits, "node"
    ).repartition("tree", "block")
    for k in range(bits):
        left = [f"d{j}" for j in range(k + 1, bits)]
        child = F.struct(F.col(f"d{k}").alias("digit"), F.col("node").alias("node"))
        rows = rows.groupBy("tree", "levels", "block", *left).agg(
            F.transform(F.array_sort(F.collect_list(child)), lambda c: c["node"]).alias("children")
        )
        hashes = F.transform("children", lambda c: c["hash"])
        hash_ = F.when(F.col("levels") > level + k, combine(hashes)).otherwise(hashes[0])
        node = F.struct(hash_.alias("hash"), F.col("children").alias("children"))
        rows = rows.select("tree", "levels", "block", *left, node.alias("node"))
    return rows.withColumnRenamed("block", "rank")


def _paths(node: Column, levels: Column, level: int, depth: int) -> Column:
    """``(node, path)`` of every lowest node under a nested one; paths run upwards, to ``node``."""
    if depth == 0:
        return F.array(F.struct(node.alias("node"), F.array().cast(f"array<{STEP}>").alias("path")))
    children = node["children"]

    def under(child: Column, place: Column) -> Column:
        # The other child of two; none where the run has one.
        other = F.get(children, 1 - place)["hash"]
        step = F.array(F.struct((place == 1).alias("before"), other.alias("sibling")))
        above = F.when(levels >= level + depth, step).otherwise(F.array().cast(f"array<{STEP}>"))
        return F.transform(
            _paths(child, levels, level, depth - 1),
            lambda p: F.struct(p["node"].alias("node"), F.concat(p["path"], above).alias("path")),
        )

    return F.flatten(F.transform(children, under))


def _down(blocks: DataFrame, above: DataFrame, level: int, bits: int) -> DataFrame:
    """The nodes of ``blocks``, each with its path, from ``above``: ``tree, rank, top, path`` of the blocks' tops.

    Both sides are stacked and folded by block, of which either side has one row.
    """
    none = {"top": F.lit(None).cast("struct<root:string,subroot:string>")}
    none["above"] = F.lit(None).cast(f"array<{STEP}>")
    rows = blocks.select("tree", "rank", "levels", "node").withColumns(none)
    missing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("levels", "node")}
    tops = above.select("tree", "rank", F.col("path").alias("above"), "top").withColumns(missing)
    met = (
        rows.unionByName(tops)
        .groupBy("tree", "rank")
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "node", "top", "above")])
    )
    found = F.explode(_paths(F.col("node"), F.col("levels"), level, bits)).alias("found")
    return met.select("tree", "top", "above", found).select(
        "tree",
        "top",
        "found.node",
        F.concat("found.path", "above").alias("path"),
    )


def _grown(nodes: DataFrame) -> list[tuple[DataFrame, int, int]]:
    """The blocks over ``nodes`` (``tree, levels, rank, node``), with their level and digits, until each tree is one row."""
    height = max(nodes.agg(F.max("levels")).first()[0] or 0, 1)
    grown: list[tuple[DataFrame, int, int]] = []
    for level in range(0, height, BITS):
        if grown:
            top = F.struct(F.col("node.hash").alias("hash"), F.col("rank").alias("rank"))
            nodes = grown[-1][0].select("tree", "levels", "rank", top.alias("node"))
        bits = min(BITS, height - level)
        grown.append((durable(_blocks(nodes, level, bits)), level, bits))
    return grown


def _proofs(grown: list[tuple[DataFrame, int, int]], above: DataFrame) -> DataFrame:
    """``tree, top, node, path`` of every node under the lowest blocks."""
    for blocks, level, bits in reversed(grown):
        above = _down(blocks, above, level, bits)
        if level:
            above = above.select("tree", "top", F.col("node.rank").alias("rank"), "path")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and a path lead to."""
    return F.aggregate(
        path,
        leaf,
        lambda at, step: F.sha2(
            F.when(step["sibling"].isNull(), at)
            .when(step["before"], F.concat(step["sibling"], at))
            .otherwise(F.concat(at, step["sibling"])),
            256,
        ),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``n_chars``, ``leaf``, ``subroot``, ``root``, ``path`` of every row of ``docs``,
    and ``forged``, the leaf it would have if ``n_chars`` were one more.

    A leaf is the SHA-256 of all five columns.  Per ``lang`` (null is one), leaves stand by ``doc_id``, null first,
    then by their hash; every two neighbours become the hash of both, the last one alone its own, until one
    is left, the subroot.  Subroots by ``lang``, null first, become ``root`` likewise.

    ``path`` runs upwards: steps with ``sibling`` (null where a node has none) and whether it stands ``before``.
    Equal rows are leaves of their own; texts may be of any length, as only hashes travel; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        F.col("n_chars").cast("long"),
        F.col("text").cast("string"),
    )
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaves = durable(
        rows.select(
            "doc_id", "lang", "n_chars", leaf_hash().alias("leaf"), leaf_hash(n_chars=more).alias("forged"),
            # Tells equal rows apart, so that no range of the order is heavier than a task should be.
            F.monotonically_increasing_id().alias("row"),
        )
    )
    node = F.struct(F.col("leaf").alias("hash"), "doc_id", "n_chars", "forged")
    ranked = _ranked(leaves, "lang", ["doc_id", "leaf", "row"])
    trees = _grown(ranked.select(F.col("lang").alias("tree"), "levels", "rank", node.alias("node")))

    subroots = durable(
        trees[-1][0].select(F.col("tree").alias("lang"), F.col("node.hash").alias("hash"), F.lit(0).alias("all"))
    )
    node = F.struct("hash", "lang")
    ranked = _ranked(subroots, "all", ["lang"])
    over = _grown(ranked.select(F.col("all").alias("tree"), "levels", "rank", node.alias("node")))
    root = over[-1][0].select(
        "tree", "rank",
        F.array().cast(f"array<{STEP}>").alias("path"),
        F.struct(F.col("node.hash").alias("root"), F.lit(None).cast("string").alias("subroot")).alias("top"),
    )
    tops = _proofs(over, root).select(
        F.col("node.lang").alias("tree"),
        F.lit(0).cast("long").alias("rank"),
        "path",
        F.struct("top.root", F.col("node.hash").alias("subroot")).alias("top"),
    )
    return _proofs(trees, tops).select(
        "node.doc_id", F.col("tree").alias("lang"), "node.n_chars", F.col("node.hash").alias("leaf"),
        "node.forged", "top.subroot", "top.root", "path",
    )


def audit(proofs: DataFrame, tampered: Column) -> DataFrame:
    """Every row of a manifest folded again from its leaf, or from its forged leaf where ``tampered`` is true."""
    leaf = F.when(tampered, F.col("forged")).otherwise(F.col("leaf"))
    siblings = F.array_join(F.transform("path", lambda s: s["sibling"]), "")
    return proofs.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold(leaf, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
