"""The document catalogue: every customer as a hotel document, events and parts as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.operators import catalogue
from stayspark.registry.base import query, read


def _hotels(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per customer.  An overdrawn one has no STAR field at all."""
    nation, region = read(spark, folder, "nation"), read(spark, folder, "region")
    balance = F.col("c_acctbal")
    star = F.when(balance >= 0, F.floor(balance / 2000).cast("string"))
    text = F.to_json(
        F.struct(
            F.col("c_custkey").cast("string").alias("ID"),
            F.col("c_name").alias("NAME"),
            star.alias("STAR"),
            F.col("n_name").alias("CITY"),
            F.col("r_name").alias("COUNTRY"),
        )
    )
    rows = (
        read(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", text.alias("text"))
    )
    return catalogue.collection(rows, "text", "c_custkey")


def _event_docs(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.collection(read(spark, folder, "events"), "props", "event_id")


def _part_docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "part").select(
        "p_partkey",
        F.to_json(
            F.struct(
                F.col("p_partkey").cast("string").alias("ID"),
                F.split("p_name", " ").alias("FACILITIES"),
            )
        ).alias("text"),
    )
    return catalogue.collection(rows, "text", "p_partkey")


_HOTELS = """
WITH hotels AS (
  SELECT c_custkey AS seq, CAST(c_custkey AS VARCHAR) AS "ID", c_name AS "NAME",
    CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) END
      AS "STAR", n_name AS "CITY", r_name AS "COUNTRY"
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(_HOTELS + "SELECT * FROM hotels")
def doc_project(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.project(_hotels(spark, folder))


@query(_HOTELS + """SELECT * FROM hotels WHERE "COUNTRY" = 'EUROPE' AND "STAR" = '3'""")
def doc_search(spark: SparkSession, folder: str) -> DataFrame:
    found = catalogue.find(_hotels(spark, folder), {"COUNTRY": "EUROPE", "STAR": "3"})
    return catalogue.project(found)


@query("SELECT count(*) AS documents FROM events")
def doc_count(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.count(_event_docs(spark, folder))


@query(
    """SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
  CAST(NULL AS VARCHAR) AS "ID" FROM events
UNION ALL
SELECT p_partkey, NULL, CAST(p_partkey AS VARCHAR) FROM part"""
)
def doc_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of another shape join the collection; fields they lack read as NULL."""
    docs = catalogue.insert(_event_docs(spark, folder), _part_docs(spark, folder))
    return catalogue.project(docs, ["k", "ID"])


@query("SELECT 0 AS documents, count(*) AS cleared FROM events")
def doc_clear(spark: SparkSession, folder: str) -> DataFrame:
    """Delete all documents."""
    docs = _event_docs(spark, folder)
    left = catalogue.count(catalogue.clear(docs)).select(F.col("documents").cast("int"))
    return left.crossJoin(catalogue.count(docs).toDF("cleared"))  # one row each


@query(
    """SELECT kind, count(*) AS documents FROM (
  SELECT CASE WHEN c_acctbal < 0 THEN 'VOID' WHEN c_custkey % 3 = 0 THEN 'STRING'
    WHEN c_custkey % 3 = 1 THEN 'BIGINT' ELSE 'BOOLEAN' END AS kind FROM customer) GROUP BY kind"""
)
def doc_value_types(spark: SparkSession, folder: str) -> DataFrame:
    """The types that one field of the documents has; they differ from document to document."""
    number = F.col("c_custkey")
    value = (
        F.when(F.col("c_acctbal") < 0, "null")
        .when(number % 3 == 0, F.concat(F.lit('"'), number.cast("string"), F.lit('"')))
        .when(number % 3 == 1, number.cast("string"))
        .otherwise("true")
    )
    text = F.concat(F.lit('{"X": '), value, F.lit("}"))
    docs = catalogue.collection(
        read(spark, folder, "customer").withColumn("text", text), "text", "c_custkey"
    )
    return catalogue.field_types(docs, "X").groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


_FIRST = (
    _HOTELS
    + """, victims AS (
  SELECT "CITY" AS key, min(seq) AS seq FROM hotels
  WHERE "CITY" IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey)
  GROUP BY "CITY")
"""
)


def _delete_first(spark: SparkSession, folder: str) -> catalogue.Deleted:
    cities = (
        read(spark, folder, "supplier")
        .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("n_name")
    )
    return catalogue.delete_first(_hotels(spark, folder), cities, "CITY")


@query(_FIRST + """SELECT seq, "ID", "CITY" FROM hotels WHERE seq NOT IN (SELECT seq FROM victims)""")
def doc_delete_first(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.project(_delete_first(spark, folder).remaining, ["ID", "CITY"])


@query(_FIRST + "SELECT key, seq FROM victims")
def doc_deleted(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_first(spark, folder).deleted.select("key", "seq")


@query(
    _HOTELS
    + """, asked AS (SELECT n_name AS key, count(*) AS requests FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
  ranked AS (SELECT seq, "CITY" AS key, row_number() OVER (PARTITION BY "CITY" ORDER BY seq) AS n FROM hotels)
SELECT key, seq FROM ranked JOIN asked USING (key) WHERE n <= requests"""
)
def doc_deleted_in_turn(spark: SparkSession, folder: str) -> DataFrame:
    """A city is named once for each of its suppliers, and each time loses the first hotel that is left."""
    cities = (
        read(spark, folder, "supplier")
        .join(read(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("n_name")
    )
    return catalogue.delete_in_turn(_hotels(spark, folder), cities, "CITY").deleted


@query(
    """SELECT p_partkey AS seq, CAST(p_partkey AS VARCHAR) AS "ID" FROM part
WHERE list_contains(string_split(p_name, ' '), 'ring')"""
)
def doc_with_facility(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.project(
        catalogue.with_item(_part_docs(spark, folder), "FACILITIES", "ring"), ["ID"]
    )


@query(
    """SELECT item, count(*) AS documents
FROM (SELECT unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY item"""
)
def doc_facilities(spark: SparkSession, folder: str) -> DataFrame:
    return (
        catalogue.items(_part_docs(spark, folder), "FACILITIES")
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
