"""Exact copies: grouping by a 128-bit content hash, checked byte by byte inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.llm.joins import sized
from stayspark.session import durable

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def hash128(sha: Column) -> Column:
    """The first 128 bits of a SHA-256 in hexadecimal digits."""
    return F.unhex(F.substring(sha, 1, 32))


def _copy_groups(docs: DataFrame, content_hash: Callable[[Column], Column]) -> tuple:
    """The rows' hashes, the groups of several rows by hash, and those of colliding hashes by text."""
    sha = F.sha2(normalised(F.col("text")), 256)
    prints = durable(docs.select("doc_id", sha.alias("sha")))
    by_id = prints.groupBy(content_hash(F.col("sha")).alias("hash"), "doc_id").agg(
        F.count(F.lit(1)).alias("rows")
    )
    repeated = durable(
        by_id.groupBy("hash")
        .agg(F.sum("rows").alias("size"), F.max("rows").alias("of_one_id"))
        .where("size > 1")
        .select("hash", "of_one_id")
    )
    count = repeated.count()

    def exact(hashes: DataFrame, rows: int) -> DataFrame:
        """Rows with these hashes grouped by their bytes as well."""
        texts = docs.select("doc_id", normalised(F.col("text")).alias("text"))
        hashed = texts.withColumn("hash", content_hash(F.sha2("text", 256)))
        inside = hashed.join(sized(hashes.select("hash"), rows), "hash", "left_semi")
        return inside.groupBy("hash", "text").agg(
            F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")
        )

    groups = durable(
        exact(repeated, count)
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("keep").alias("keep"), F.sum("size").alias("size"))
    )
    colliding = groups.where("texts > 1")
    collisions = colliding.count()
    by_text = durable(exact(colliding, collisions)) if collisions else None
    again = repeated.where("of_one_id > 1").limit(1).count() > 0
    return prints, groups.where("texts = 1").drop("texts"), by_text, count, collisions, again


def _marked(rows: DataFrame, groups: DataFrame, by_text, count: int, collisions: int) -> DataFrame:
    """``rows`` (with ``_copy_hash``) and ``_copy_keep``, ``_copy_size`` of their groups."""
    groups = groups.toDF("_copy_hash", "_copy_keep", "_copy_size")
    out = rows.join(sized(groups, count), "_copy_hash", "left")
    if by_text is not None:
        names = ["_copy_hash", "_copy_text", "_copy_keep2", "_copy_size2"]
        by_text = sized(by_text.toDF(*names), collisions)
        out = (
            out.join(by_text, names[:2], "left")
            .withColumn("_copy_keep", F.coalesce("_copy_keep", "_copy_keep2"))
            .withColumn("_copy_size", F.coalesce("_copy_size", "_copy_size2"))
        )
    return out


def mark_copies(
    docs: DataFrame, content_hash: Callable[[Column], Column] = hash128
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after ``normalised``; null counts as empty.  Of equal texts the
    smallest ``doc_id`` stays (null only if there is no other).  A row repeated with its id counts
    in ``group_size`` and is marked as its twin is.  An empty table gives no rows; other columns
    are ignored.

    Rows are grouped by hash from counts alone.  Only texts whose hash occurs again are
    grouped by their bytes too, so a collision splits its group.  A hot group is folded by partial
    aggregation in the map tasks, and its marks reach the rows by a broadcast of checked size, or a
    shuffled join whose hot partitions adaptive execution splits.
    """
    prints, groups, by_text, count, collisions, _ = _copy_groups(docs, content_hash)
    rows = prints.withColumn("_copy_hash", content_hash(F.col("sha")))
    if by_text is not None:
        texts = docs.select("doc_id", normalised(F.col("text")).alias("_copy_text"))
        sha = F.sha2("_copy_text", 256)
        rows = texts.withColumn("sha", sha).withColumn("_copy_hash", content_hash(sha))
    keep = F.when(F.col("_copy_size").isNull(), F.col("doc_id")).otherwise(F.col("_copy_keep"))
    return _marked(rows, groups, by_text, count, collisions).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_copy_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns unchanged.

    The row is one with the smallest ``doc_id``; of rows repeated with that id, one stays.
    """
    _, groups, by_text, count, collisions, again = _copy_groups(docs, content_hash)
    text = normalised(F.col("text"))
    rows = docs.withColumn("_copy_hash", content_hash(F.sha2(text, 256)))
    if by_text is not None:
        rows = rows.withColumn("_copy_text", text)
    marked = _marked(rows, groups, by_text, count, collisions)
    stays = F.col("_copy_size").isNull() | F.col("doc_id").eqNullSafe(F.col("_copy_keep"))
    kept = marked.where(stays)
    if again:
        key = ["doc_id", "_copy_hash"] + (["_copy_text"] if by_text is not None else [])
        kept = kept.dropDuplicates(key)
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])
