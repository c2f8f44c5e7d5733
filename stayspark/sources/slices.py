"""Tables stored in slices, each a range of keys: jobs read and replace only the slices they need."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stayspark.functions.numbers import int_div

SLICE = "_slice"
# The folder that Spark writes rows without a slice number to.
_NO_SLICE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Sliced:
    """A Parquet folder with one partition per ``width`` consecutive values of a whole-number column.

    Keys handed out in turn make recent rows neighbours, so what changes lies in few slices.  Rows without a
    key are a slice of their own.  The number of slices is the range of keys over ``width``; lists of slice
    numbers pass through the driver, so choose ``width`` for no more than some 100,000 of them.
    """

    folder: str
    key: str
    width: int
    schema: StructType

    def number(self, key: str | None = None) -> Column:
        return int_div(F.col(key or self.key).cast("bigint"), self.width).alias(SLICE)

    def read(self, spark: SparkSession, slices: Collection[int | None] | None = None) -> DataFrame:
        """The rows of the given slices, all of them by default; files of other slices are not opened."""
        numbered = StructType([*self.schema.fields, StructField(SLICE, LongType())])
        rows = spark.read.schema(numbered).parquet(self.folder)
        if slices is not None:
            wanted = F.col(SLICE).isin([s for s in slices if s is not None])
            rows = rows.where(wanted | F.col(SLICE).isNull() if None in slices else wanted)
        return rows.select(*self.schema.names)

    def _write(self, rows: DataFrame, dynamic: bool) -> None:
        numbered = rows.select(*self.schema.names, self.number())
        # Adaptive execution cuts a slice that is too large into several tasks and puts small ones together.
        dealt = numbered.hint("rebalance", SLICE).sortWithinPartitions(SLICE, self.key)
        writer = dealt.write.mode("overwrite").partitionBy(SLICE)
        if dynamic:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.folder)

    def write(self, rows: DataFrame) -> None:
        """Store a table anew."""
        self._write(rows, dynamic=False)

    def replace(self, rows: DataFrame, slices: Collection[int | None]) -> None:
        """Put ``rows`` in the place of all that the given slices hold; the other slices stay untouched.

        ``rows`` is read twice and must not read this folder itself: pass a stored frame, all of whose rows
        belong to the given slices.  Spark moves the new files into place slice by slice when the job ends;
        a run that is stopped there is repeated as a whole.
        """
        self._write(rows, dynamic=True)
        kept = {row[0] for row in rows.select(self.number()).distinct().collect()}
        empty = rows.sparkSession.createDataFrame([], self.schema)
        for number in set(slices) - kept:  # Spark leaves a slice alone for which there is no row.
            name = _NO_SLICE if number is None else number
            empty.write.mode("overwrite").parquet(f"{self.folder}/{SLICE}={name}")


def slice_numbers(keys: DataFrame, width: int) -> list[int | None]:
    """The slices in which the keys of a one-column frame lie."""
    key = F.col(keys.columns[0]).cast("bigint")
    return [row[0] for row in keys.select(int_div(key, width)).distinct().collect()]
