"""Typed ingest of line items written out as text, some of it malformed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.operators.ingest import Ingested, typed_ingest
from stayspark.registry.base import query, read

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KINDS = {"quantity": "int", "cancelled": "bool", "ship_day": "date", "note": "str"}


def _ingest(spark: SparkSession, folder: str) -> Ingested:
    unit = F.when(F.col("l_linestatus") == "O", " ").otherwise(" pcs")
    flag = F.when(F.col("l_returnflag") == "R", "True").when(F.col("l_returnflag") == "A", " 0 ")
    shipped = F.col("l_shipdate").cast("date")
    # No single column identifies a line.
    raw = read(spark, folder, "lineitem").select(
        F.concat_ws("/", *[F.col(c).cast("string") for c in LINE]).alias("line"),
        F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), unit).alias("quantity"),
        flag.otherwise("no").alias("cancelled"),
        # The day runs past the end of some months.
        F.concat_ws(
            "-",
            F.year(shipped).cast("string"),
            F.month(shipped).cast("string"),
            (F.dayofmonth(shipped) + F.col("l_linenumber")).cast("string"),
        ).alias("ship_day"),
        F.concat(F.lit("  "), F.col("l_returnflag"), F.lit("  ")).alias("note"),
    )
    return typed_ingest(raw, KINDS, "lineitem", "line")


_BASE = """
WITH raw AS (
  SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line,
    ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
      || CASE WHEN l_linestatus = 'O' THEN ' ' ELSE ' pcs' END AS quantity,
    CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN ' 0 ' ELSE 'no' END AS cancelled,
    CAST(year(l_shipdate) AS VARCHAR) || '-' || CAST(month(l_shipdate) AS VARCHAR) || '-'
      || CAST(day(l_shipdate) + l_linenumber AS VARCHAR) AS ship_day,
    '  ' || l_returnflag || '  ' AS note
  FROM lineitem),
typed AS (
  SELECT *, TRY_CAST(trim(quantity) AS BIGINT) AS q,
    CASE WHEN lower(trim(cancelled)) IN ('1', 'true') THEN 1
         WHEN lower(trim(cancelled)) IN ('0', 'false') THEN 0 END AS c,
    TRY_CAST(trim(ship_day) AS DATE) AS d
  FROM raw)
"""


@query(
    _BASE
    + """SELECT line, q AS quantity, c AS cancelled, d AS ship_day, trim(note) AS note
FROM typed WHERE q IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL"""
)
def typed_ingest_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _ingest(spark, folder).clean


@query(
    _BASE
    + """SELECT 'lineitem' AS table_name, line, 'quantity' AS column_name, quantity AS raw,
  'expected int' AS reason FROM typed WHERE q IS NULL
UNION ALL
SELECT 'lineitem', line, 'cancelled', cancelled, 'expected bool' FROM typed WHERE c IS NULL
UNION ALL
SELECT 'lineitem', line, 'ship_day', ship_day, 'expected date' FROM typed WHERE d IS NULL"""
)
def typed_ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _ingest(spark, folder).rejects
