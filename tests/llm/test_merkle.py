"""Merkle manifests against a tree built level by level, with hashes folded from raw bytes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stayspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank string, tree int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    return sha(*map(field, row))


def tree(leaves):
    """The root, and of every leaf its steps upwards: whether the sibling stands before, and its hash."""
    paths, under, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        for i in range(0, len(level), 2):
            run = level[i : i + 2]
            for j in range(len(run)):
                for k in under[i + j]:
                    paths[k].append((j == 1, run[1 - j] if len(run) == 2 else None))
        under = [sum(under[i : i + 2], []) for i in range(0, len(level), 2)]
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    built = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[lang] = tree([leaf(r) for r in members])
    order = sorted(built, key=lambda g: (g is not None, (g or "").encode()))
    root, over = tree([built[g][0] for g in order]) if order else (None, [])
    out = []
    for lang, above in zip(order, over, strict=True):
        subroot, paths = built[lang]
        for row, path in zip(groups[lang], paths, strict=True):
            path, forged = path + above, row
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                forged = (*row[:3], row[3] + 1, row[4])
            at = leaf(forged)
            for before, other in path:
                at = sha(at) if other is None else sha(other, at) if before else sha(at, other)
            proof = sha(*[s for _, s in path if s])
            out.append((row[0], leaf(row), subroot, root, proof, at, at == root))
    return out


def audited(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)
    found = merkle.audit(
        merkle.manifest(frame), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    )
    return sorted(map(tuple, found.collect()), key=str)


ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (5, "a", "x", 1, "t"), (5, "a", "x", 1, "t"),
    (5, "b", "x", 1, "é🙂" * 9), (7, "", "", 0, ""), (8, "s", "ü", (1 << 63) - 1, "long " * 100_000), (9, "1:s", "-", -4, "-"),
    (0, "s", "x", 3, None), (-3, "s", "x", None, "n"),
]


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    assert audited(spark, ODD) == sorted(expected(ODD), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (37, 8, 9, 1, 16), (1, 1, 1, 1, 1)])
def test_trees_of_all_heights(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "BITS", 2)
    rows = [(i, "s", f"l{g}", i, f"text {i}") for g, n in enumerate(sizes) for i in range(1000 * g, 1000 * g + n)]
    assert audited(spark, rows) == sorted(expected(rows), key=str)


def test_no_rows(spark):
    assert audited(spark, []) == []


def test_blocks_are_bounded(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "'s' AS source", "if(id % 3 = 0, 'hot', 'b') AS lang", "id AS n_chars", "'t' AS text"
    )
    ranked = merkle._ranked(docs, "lang", ["doc_id"]).select(
        F.col("lang").alias("tree"), "levels", "rank", F.struct(F.lit("h").alias("hash"), "doc_id").alias("node")
    )
    sizes = ranked.groupBy("tree", F.shiftright("rank", merkle.BITS)).count()
    assert sizes.agg(F.max("count")).first()[0] == 1 << merkle.BITS
    assert merkle._blocks(ranked, 0, merkle.BITS).count() == sizes.count()
