"""A schema-flexible document collection held as a VARIANT column.

A collection is a DataFrame (seq BIGINT, doc VARIANT); ``seq`` is the insertion order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.operators.scans import running

# The fields of a hotel document.
HOTEL_FIELDS = ("ID", "NAME", "STAR", "CITY", "COUNTRY")


class Deleted(NamedTuple):
    remaining: DataFrame
    deleted: DataFrame


def collection(source: DataFrame, json: str, seq: str) -> DataFrame:
    """Parse JSON text into documents; text that is no JSON raises nothing and is NULL."""
    return source.select(
        F.col(seq).cast("bigint").alias("seq"), F.try_parse_json(F.col(json)).alias("doc")
    )


def field(name: str, kind: str = "string") -> Column:
    """One field of the document, NULL where it is missing."""
    return F.try_variant_get(F.col("doc"), f"$.{name}", kind)


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    return docs.unionByName(new)


def project(docs: DataFrame, fields: Sequence[str] = HOTEL_FIELDS) -> DataFrame:
    return docs.select("seq", *[field(f).alias(f) for f in fields])


def find(docs: DataFrame, equal: Mapping[str, str]) -> DataFrame:
    """Documents whose fields have the given values."""
    for name, value in equal.items():
        docs = docs.where(field(name) == F.lit(value))
    return docs


def field_types(docs: DataFrame, name: str) -> DataFrame:
    """``seq`` and the type of one field in each document; VOID for a null."""
    return docs.select("seq", F.schema_of_variant(field(name, "variant")).alias("kind"))


def count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("documents"))


def clear(docs: DataFrame) -> DataFrame:
    """The same collection without a document."""
    return docs.limit(0)


def delete_first(docs: DataFrame, keys: DataFrame, name: str) -> Deleted:
    """For each key, delete the first inserted document whose field has that value.

    The first one is a minimum per value, folded before the shuffle, and is then removed by its
    unique ``seq``: no task holds all documents of a value.
    """
    wanted = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    victims = (
        docs.select("seq", field(name).alias("key"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("seq").alias("seq"))
        .join(wanted, "key", "left_semi")
    )
    return Deleted(docs.join(victims.select("seq"), "seq", "left_anti"), victims)


def delete_in_turn(docs: DataFrame, keys: DataFrame, name: str) -> Deleted:
    """For every row of ``keys``, delete the first document that is left whose field has that value.

    So n requests for a value delete its first n documents, all if there are fewer.  Requests are counted per value, and
    documents before each one of the same value by running sums: no task holds all documents of a value.
    """
    asked = keys.where(F.col(keys.columns[0]).isNotNull()).groupBy(F.col(keys.columns[0]).alias("key"))
    asked = asked.agg(F.count(F.lit(1)).alias("requests"))
    found = docs.select("seq", field(name).alias("key")).join(asked, "key")
    ranked = running(found, ["key"], ["seq"], {"before": ("sum", F.lit(1).cast("long"))})
    victims = ranked.where("before < requests").select("key", "seq")
    return Deleted(docs.join(victims.select("seq"), "seq", "left_anti"), victims)


def with_item(docs: DataFrame, name: str, item: str) -> DataFrame:
    """Documents whose list field contains an item."""
    return docs.where(F.array_contains(field(name, "array<string>"), item))


def items(docs: DataFrame, name: str) -> DataFrame:
    """One row per document and list item."""
    return docs.select("seq", F.explode(field(name, "array<string>")).alias("item"))
