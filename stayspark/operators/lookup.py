"""Look-ups by key, distinct values, table profiles and content fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.functions.parsing import strip
from stayspark.operators.joins import keys_among
from stayspark.operators.unions import union_all


def rows_where(table: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals one value; the filter reaches the file scan."""
    if column not in table.columns:
        raise ValueError(f"unknown column {column!r}")
    return table.where(F.col(column) == F.lit(value))


def rows_with_keys(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column holds any of the keys; a value may own any number of rows."""
    wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    return table.join(wanted, column, "left_semi")


def known_keys(table: DataFrame, column: str, typed: DataFrame, key: str) -> DataFrame:
    """Typed key text (spaces around it ignored) with ``found`` telling whether the key exists.

    The text must be written as the key itself is.  It is turned into the key's type before the join, so
    that the table's column is read as it stands.
    """
    kind = table.schema[column].dataType
    asked = typed.select(strip(F.col(key)).alias("key")).distinct()
    value = F.col("key").try_cast(kind)
    asked = asked.withColumn("_value", F.when(value.cast("string") == F.col("key"), value))
    present = keys_among(
        table.select(F.col(column).alias("_value")),
        asked.select("_value").where("_value IS NOT NULL").distinct(),
    )
    return asked.join(present.withColumn("found", F.lit(True)), "_value", "left").select(
        "key", F.coalesce("found", F.lit(False)).alias("found")
    )


def invoices_for(bookings: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row per asked booking with its invoice; ``found`` is false where there is none."""
    asked = bookings.select(F.col(bookings.columns[0]).alias("BookingBookingID")).distinct()
    # Filtered first: with few asked bookings the invoices are scanned but not shuffled.
    hits = invoices.join(asked, "BookingBookingID", "left_semi").withColumn("found", F.lit(True))
    return asked.join(hits, "BookingBookingID", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    if column not in table.columns:
        raise ValueError(f"unknown column {column!r}")
    return table.select(column).distinct()


def same_content(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: how many rows the first frame has, and whether both have the same content."""
    one, two = (fingerprint(frame).toDF(*names) for frame, names in zip(
        (first, second), (("row_count", "content"), ("other_count", "other_content")), strict=True
    ))
    same = (F.col("row_count") == F.col("other_count")) & (F.col("content") == F.col("other_content"))
    return one.crossJoin(two).select("row_count", same.alias("same"))  # one row each


def dealt_out(table: DataFrame) -> DataFrame:
    """The same rows in other places: in several tasks for each part that the table is read in, so that
    their number follows its size."""
    return table.repartition(4 * table.rdd.getNumPartitions() + 1)


def value_types(table: DataFrame, *columns: str) -> DataFrame:
    """The distinct combinations of runtime types the columns hold."""
    return table.select(*[F.typeof(c).alias(c) for c in columns]).distinct()


def _widened(kind: str) -> str:
    """Whole numbers of any width are counted together."""
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, NULLs and distinct values of every column of every table.

    Each table is read once: its rows are unfolded to cells, a column's number and its value in the place of
    its type, and all cells are counted together.  Equal values are folded before the shuffle, which makes
    hot values harmless, and the second aggregation gives all three figures at once.
    """
    kinds = sorted({_widened(kind) for table in tables.values() for _, kind in table.dtypes})
    names, cells = [], []
    for table_name, table in tables.items():
        unfolded = []
        for column, kind in table.dtypes:
            places = [
                (F.col(f"`{column}`") if k == _widened(kind) else F.lit(None)).cast(k).alias(f"v{i}")
                for i, k in enumerate(kinds)
            ]
            unfolded.append(F.struct(F.lit(len(names)).alias("c"), *places))
            names.append((len(names), table_name, column))
        cells.append(table.select(F.inline(F.array(*unfolded))))
    values = [f"v{i}" for i in range(len(kinds))]
    n, missing = F.col("n"), F.coalesce(*[F.when(F.col(v).isNotNull(), False) for v in values], F.lit(True))
    figures = (
        union_all(cells)
        .groupBy("c", *values)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("c", "n", missing.alias("missing"))
        .groupBy("c")
        .agg(
            F.sum(n).alias("row_count"),
            F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("null_count"),
            F.count_if(~F.col("missing")).alias("distinct_count"),
        )
    )
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(names, "c int, table_name string, column_name string")
    # A column of an empty table has no cell at all.
    return columns.join(figures, "c", "left").select(
        "table_name",
        "column_name",
        *[F.coalesce(f, F.lit(0)).alias(f) for f in ("row_count", "null_count", "distinct_count")],
    )


def fingerprint(table: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """Row count and a content sum that depends on neither row order nor partitioning.

    The hash skips NULLs, so each column's NULL flag is hashed as well: a value that moves to another
    column changes the sum.
    """
    if row_hash is None:
        cells = [F.col(f"`{c}`") for c in table.columns]
        row_hash = F.xxhash64(*cells, *[cell.isNull() for cell in cells])
    return table.select(row_hash.cast("decimal(38,0)").alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").alias("content_sum"),
    )
