"""Batches of inserts, updates, NULLs and deletes; the change sets come from other given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.model import Check, ForeignKey, TableSpec
from stayspark.operators import change_log, changes
from stayspark.operators.catalogue import field
from stayspark.plans import edit
from stayspark.registry.base import query, read
from stayspark.session import find_package

_NATION = ForeignKey(("s_nationkey",), "nation", ("n_nationkey",))

SUPPLIER = TableSpec(
    "supplier",
    ("s_suppkey",),
    not_null=("s_nationkey",),
    checks=(Check("s_balance", "s_acctbal >= 5", ("s_acctbal",)),),
    foreign_keys=(_NATION,),
)
CUSTOMER = TableSpec(
    "customer",
    ("c_custkey",),
    not_null=("c_name", "c_nationkey"),
    checks=(
        Check("c_balance", "c_acctbal >= 0", ("c_acctbal",)),
        Check("c_reserve", "c_acctbal >= 10 * c_nationkey", ("c_acctbal", "c_nationkey")),
    ),
    foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),),
)
ORDERS = TableSpec("orders", ("o_orderkey",))
CLAIM = TableSpec("claim", ("claim_id",), unique=(("seat",),))


def _event_number() -> Column:
    """The number inside an event's JSON properties."""
    return field("k", "int")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").withColumn("doc", F.try_parse_json("props"))


# Inserts: every event asks for a supplier row with its user as the key.
_INSERT = """
WITH batch AS (
  SELECT event_id, user_id AS s_suppkey, event_type AS s_name,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS s_nationkey, value AS s_acctbal
  FROM events),
marked AS (
  SELECT *, CASE
    WHEN s_nationkey IS NULL THEN 'not_null s_nationkey'
    WHEN NOT (s_acctbal >= 5) THEN 'check s_balance'
    WHEN s_nationkey NOT IN (SELECT n_nationkey FROM nation) THEN 'foreign_key s_nationkey->nation'
    WHEN s_suppkey IN (SELECT s_suppkey FROM supplier) THEN 'duplicate s_suppkey' END AS reason
  FROM batch),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s_suppkey, reason IS NULL ORDER BY event_id) AS rn
  FROM marked)
"""


def _insert(spark: SparkSession, folder: str) -> changes.Applied:
    batch = _events(spark, folder).select(
        F.col("user_id").alias("s_suppkey"),
        F.col("event_type").alias("s_name"),
        _event_number().alias("s_nationkey"),
        F.col("value").alias("s_acctbal"),
        "event_id",
    )
    return changes.insert_rows(
        read(spark, folder, "supplier"),
        batch,
        SUPPLIER,
        "event_id",
        {"nation": read(spark, folder, "nation")},
    )


@query(
    _INSERT
    + """SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM ranked WHERE reason IS NULL AND rn = 1"""
)
def apply_insert(spark: SparkSession, folder: str) -> DataFrame:
    return _insert(spark, folder).table


@query(
    _INSERT
    + """SELECT event_id, s_suppkey, coalesce(reason, 'duplicate in batch') AS reason
FROM ranked WHERE reason IS NOT NULL OR rn > 1"""
)
def apply_insert_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _insert(spark, folder).rejected.select("event_id", "s_suppkey", "reason")


# Whether a row gets in depends on all earlier rows: the recursion carries the users and seats that
# are taken and goes on with the earliest event that is free of both.
@query(
    """
WITH RECURSIVE b AS (
  SELECT event_id, user_id AS claim_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS seat
  FROM events),
s AS (
  SELECT event_id, claim_id, seat, [claim_id] AS users, [seat] AS seats FROM b
  WHERE event_id = (SELECT min(event_id) FROM b)
  UNION ALL
  SELECT n.event_id, n.claim_id, n.seat, list_append(n.users, n.claim_id), list_append(n.seats, n.seat)
  FROM (
    SELECT min(b.event_id) AS event_id, arg_min(b.claim_id, b.event_id) AS claim_id,
      arg_min(b.seat, b.event_id) AS seat, any_value(s.users) AS users, any_value(s.seats) AS seats
    FROM s JOIN b ON b.event_id > s.event_id
      AND NOT list_contains(s.users, b.claim_id) AND NOT list_contains(s.seats, b.seat)
  ) n WHERE n.event_id IS NOT NULL)
SELECT claim_id, seat FROM s"""
)
def apply_insert_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every event claims a seat for its user; user and seat are unique."""
    batch = _events(spark, folder).select(
        F.col("user_id").alias("claim_id"), _event_number().alias("seat"), "event_id"
    )
    empty = batch.select("claim_id", "seat").limit(0)
    return changes.insert_rows(empty, batch, CLAIM, "event_id").accepted


# Updates by key: every event moves its user to the nation it names.
_MOVES = """
WITH asked AS (
  SELECT event_id, user_id AS c_custkey, CAST(json_extract_string(props, '$.k') AS INTEGER) AS value
  FROM events),
marked AS (
  SELECT a.*, CASE
    WHEN value IS NULL THEN 'not_null c_nationkey'
    WHEN value NOT IN (SELECT n_nationkey FROM nation) THEN 'foreign_key c_nationkey->nation'
    WHEN NOT coalesce(c.c_acctbal >= 10 * value, TRUE) THEN 'check c_reserve' END AS reason
  FROM asked a LEFT JOIN customer c USING (c_custkey)),
last AS (
  SELECT c_custkey, arg_max(value, event_id) AS value FROM marked WHERE reason IS NULL
  GROUP BY c_custkey)
"""


def _moves(spark: SparkSession, folder: str) -> changes.Applied:
    asked = _events(spark, folder).select(
        "event_id", F.col("user_id").alias("c_custkey"), _event_number().alias("value")
    )
    return changes.update_rows(
        read(spark, folder, "customer"),
        asked,
        CUSTOMER,
        "c_custkey",
        "c_nationkey",
        "event_id",
        {"nation": read(spark, folder, "nation")},
    )


@query(
    _MOVES
    + """SELECT c_custkey, c_name, coalesce(value, c_nationkey) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer LEFT JOIN last USING (c_custkey)"""
)
def apply_update(spark: SparkSession, folder: str) -> DataFrame:
    return _moves(spark, folder).table


@query(_MOVES + "SELECT event_id, c_custkey, value, reason FROM marked WHERE reason IS NOT NULL")
def apply_update_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _moves(spark, folder).rejected


@query(
    _MOVES
    + """, known AS (
  SELECT m.*, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = m.c_custkey) AS known FROM marked m)
SELECT event_id, c_custkey, reason, CASE
  WHEN reason IS NOT NULL THEN 'rejected'
  WHEN NOT known THEN 'unknown key'
  WHEN event_id < max(event_id) FILTER (reason IS NULL) OVER (PARTITION BY c_custkey) THEN 'superseded'
  ELSE 'accepted' END AS outcome
FROM known"""
)
def apply_update_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every request; users beyond the customers are unknown, most come several times."""
    return _moves(spark, folder).outcomes


# Edits as typed text: key and value may not parse, may break a rule, or name no customer.
_EDITS = """
WITH raw AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN 'no ' ELSE ' ' END || user_id || ' ' AS key,
    CASE event_type WHEN 'view' THEN json_extract_string(props, '$.k') || '.5'
      ELSE json_extract_string(props, '$.k') || chr(9) END AS value
  FROM events),
typed AS (
  SELECT *, TRY_CAST(regexp_replace(key, '^ | $', '', 'g') AS BIGINT) AS c_custkey,
    CASE WHEN value NOT LIKE '%.5' THEN CAST(replace(value, chr(9), '') AS INTEGER) END AS n FROM raw),
marked AS (
  SELECT t.*, c.c_custkey IS NOT NULL AS known, CASE
    WHEN n NOT IN (SELECT n_nationkey FROM nation) THEN 'foreign_key c_nationkey->nation'
    WHEN NOT coalesce(c.c_acctbal >= 10 * n, TRUE) THEN 'check c_reserve' END AS reason
  FROM typed t LEFT JOIN customer c USING (c_custkey) WHERE t.c_custkey IS NOT NULL AND n IS NOT NULL)
"""


def _edits(spark: SparkSession, folder: str) -> edit.Edited:
    kind, number = F.col("event_type"), _event_number().cast("string")
    raw = _events(spark, folder).select(
        "event_id",
        F.concat(
            F.when(kind == "error", "no ").otherwise(" "), F.col("user_id").cast("string"), F.lit(" ")
        ).alias("key"),
        F.concat(number, F.when(kind == "view", ".5").otherwise("\t")).alias("value"),
    )
    parents = {"nation": read(spark, folder, "nation")}
    customers = read(spark, folder, "customer")
    return edit.edit_rows(customers, raw, CUSTOMER, "c_nationkey", "int", "event_id", parents)


@query(
    _EDITS
    + """SELECT c_custkey, c_name, coalesce(n, c_nationkey) AS c_nationkey FROM customer LEFT JOIN (
  SELECT c_custkey, arg_max(n, event_id) AS n FROM marked WHERE reason IS NULL GROUP BY c_custkey)
USING (c_custkey)"""
)
def typed_edit(spark: SparkSession, folder: str) -> DataFrame:
    return _edits(spark, folder).table.select("c_custkey", "c_name", "c_nationkey")


@query(
    _EDITS
    + """SELECT event_id, 'key' AS column_name, key AS raw, 'expected int' AS reason
FROM typed WHERE c_custkey IS NULL
UNION ALL SELECT event_id, 'value', value, 'expected int' FROM typed WHERE n IS NULL"""
)
def typed_edit_unparsed(spark: SparkSession, folder: str) -> DataFrame:
    return _edits(spark, folder).unparsed.select("event_id", "column_name", "raw", "reason")


@query(
    _EDITS
    + """SELECT event_id, c_custkey, reason, CASE WHEN reason IS NOT NULL THEN 'rejected'
  WHEN NOT known THEN 'unknown key'
  WHEN event_id < max(event_id) FILTER (reason IS NULL) OVER (PARTITION BY c_custkey) THEN 'superseded'
  ELSE 'accepted' END AS outcome FROM marked"""
)
def typed_edit_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _edits(spark, folder).outcomes


# Updates by a column many rows share: every supplier sets the balance of its nation's customers.
@query(
    """WITH last AS (
  SELECT s_nationkey AS c_nationkey, arg_max(s_acctbal, s_suppkey) AS value
  FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey),
allowed AS (SELECT * FROM last WHERE value >= 10 * c_nationkey)
SELECT c_custkey, c_name, c_nationkey, coalesce(value, c_acctbal) AS c_acctbal, c_mktsegment
FROM customer LEFT JOIN allowed USING (c_nationkey)"""
)
def apply_update_by_column(spark: SparkSession, folder: str) -> DataFrame:
    asked = read(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("value")
    )
    return changes.update_rows(
        read(spark, folder, "customer"), asked, CUSTOMER, "c_nationkey", "c_acctbal", "s_suppkey"
    ).table


@query(
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') THEN NULL
       ELSE c_mktsegment END AS c_mktsegment
FROM customer"""
)
def apply_null(spark: SparkSession, folder: str) -> DataFrame:
    failed = read(spark, folder, "events").where("event_type = 'error'")
    keys = failed.select("event_id", F.col("user_id").alias("c_custkey"))
    return changes.null_values(
        read(spark, folder, "customer"), keys, CUSTOMER, "c_custkey", "c_mktsegment", "event_id"
    ).table


@query("SELECT event_id, user_id AS c_custkey, 'not_null c_name' AS reason FROM events")
def apply_null_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """A required column cannot be blanked: every request comes back, whoever it names."""
    keys = read(spark, folder, "events").select("event_id", F.col("user_id").alias("c_custkey"))
    return changes.null_values(
        read(spark, folder, "customer"), keys, CUSTOMER, "c_custkey", "c_name", "event_id"
    ).rejected.select("event_id", "c_custkey", "reason")


def _delete_by_customer(spark: SparkSession, folder: str) -> changes.Applied:
    """Delete all orders of every customer with events, unless one of them is referenced."""
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    keys = read(spark, folder, "events").select(F.col("user_id").alias("o_custkey"))
    children = [(read(spark, folder, "supplier"), "s_suppkey")]
    return changes.delete_rows(orders, keys, ORDERS, "o_custkey", children)


# Deletes: cancelled orders go, unless a line item still points at them.
def _delete_cancelled(spark: SparkSession, folder: str) -> changes.Applied:
    orders = read(spark, folder, "orders")
    keys = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    children = [(read(spark, folder, "lineitem"), "l_orderkey")]
    return changes.delete_rows(orders, keys, ORDERS, "o_orderkey", children)


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderstatus <> 'F' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def apply_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_cancelled(spark, folder).table.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    """SELECT o_orderkey, 'referenced' AS reason FROM orders
WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"""
)
def apply_delete_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_cancelled(spark, folder).rejected


@query(
    """WITH asked AS (SELECT user_id AS o_custkey, count(*) AS requests FROM events GROUP BY user_id)
SELECT o_custkey, requests, CASE WHEN blocked THEN 'rejected' WHEN known THEN 'accepted' ELSE 'unknown key' END
  AS outcome, CASE WHEN blocked THEN 'referenced' END AS reason
FROM (
  SELECT *, o_custkey IN (SELECT o_custkey FROM orders) AS known, o_custkey IN (
    SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT s_suppkey FROM supplier)) AS blocked
  FROM asked)"""
)
def apply_delete_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_by_customer(spark, folder).outcomes


@query(
    """SELECT o_orderkey, o_custkey FROM orders
WHERE NOT (o_custkey IN (SELECT user_id FROM events)
  AND o_custkey NOT IN (
    SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT s_suppkey FROM supplier)))"""
)
def apply_delete_by_column(spark: SparkSession, folder: str) -> DataFrame:
    return _delete_by_customer(spark, folder).table


# One log over two tables: events insert, move and remove suppliers, and remove and bring back the parts that they supply.
# The SQL enters them one by one: the recursion carries the parts that are there, and the suppliers with part and nickname.
_NICKED = TableSpec(
    "supplier",
    ("s_suppkey",),
    not_null=("s_nick",),
    unique=(("s_nick",),),
    foreign_keys=(ForeignKey(("s_partkey",), "part", ("p_partkey",)),),
)
_PARTS = TableSpec("part", ("p_partkey",))
_LOG = """
WITH RECURSIVE b AS (
  SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, event_id % 8 AS kind, user_id + 150 * (event_id // 8 % 40) AS who,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 30 + 30 * (user_id % 20) + 1 AS part,
    user_id + 150 * (event_id // 8 % 40) + event_id % 3 AS nick
  FROM events),
s AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS reason,
    (SELECT list(CAST(p_partkey AS BIGINT)) FROM part) AS parts,
    (SELECT map(list(CAST(s_suppkey AS BIGINT)), list({'part': CAST(s_nationkey + 1 AS BIGINT), 'nick': CAST(s_suppkey AS BIGINT)}))
     FROM supplier) AS held
  UNION ALL
  SELECT n, event_id, CASE WHEN reason = 'unknown key' THEN reason WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END,
    CASE WHEN reason <> 'unknown key' THEN reason END,
    CASE WHEN reason IS NOT NULL THEN parts WHEN kind = 5 THEN list_filter(parts, lambda x: x <> part)
      WHEN kind = 6 THEN list_append(parts, part) ELSE parts END,
    CASE WHEN reason IS NOT NULL OR kind IN (5, 6) THEN held
      WHEN kind = 4 THEN map_from_entries(list_filter(map_entries(held), lambda e: e.key <> who))
      ELSE map_concat(held, map([who], [{
        'part': CASE WHEN kind IN (0, 1, 2) THEN part ELSE held[who].part END,
        'nick': CASE WHEN kind IN (0, 1, 3, 7) THEN nick ELSE held[who].nick END}])) END
  FROM (
    SELECT b.*, s.parts, s.held, CASE
      WHEN kind IN (0, 1, 2) AND part IS NOT NULL AND NOT list_contains(s.parts, part) THEN 'foreign_key s_partkey->part'
      WHEN kind IN (0, 1) AND s.held[who] IS NOT NULL THEN 'duplicate s_suppkey'
      WHEN kind IN (2, 3, 4, 7) AND s.held[who] IS NULL THEN 'unknown key'
      WHEN kind = 5 AND NOT list_contains(s.parts, part) THEN 'unknown key'
      WHEN kind = 6 AND list_contains(s.parts, part) THEN 'duplicate p_partkey'
      WHEN kind IN (0, 1, 3, 7) AND len(list_filter(map_entries(s.held), lambda e: e.key <> who AND e.value.nick = nick)) > 0
        THEN 'duplicate s_nick'
      WHEN kind = 5 AND len(list_filter(map_values(s.held), lambda v: v.part = part)) > 0 THEN 'referenced' END AS reason
    FROM s JOIN b ON b.n = s.n + 1))
SELECT event_id, CASE WHEN kind IN (5, 6) THEN 'part' ELSE 'supplier' END AS table_name,
  CASE WHEN kind IN (0, 1, 6) THEN 'insert' WHEN kind IN (4, 5) THEN 'delete' ELSE 'update' END AS op, outcome, reason
FROM s JOIN b USING (event_id)
"""


def _log(spark: SparkSession, folder: str) -> change_log.Logged:
    find_package(spark)
    kind = F.col("event_id") % 8
    who = F.col("user_id").cast("long") + 150 * (F.floor(F.col("event_id") / 8) % 40)
    part = _event_number().cast("long") % 30 + 30 * (F.col("user_id") % 20) + 1
    events = _events(spark, folder).select(
        "event_id", kind.alias("kind"), who.alias("who"), part.alias("part"), (who + F.col("event_id") % 3).alias("nick")
    )
    op = F.when(F.col("kind").isin(0, 1, 6), "insert").when(F.col("kind").isin(4, 5), "delete").otherwise("update")
    column = F.when(F.col("kind") == 2, "s_partkey").when(F.col("kind").isin(3, 7), "s_nick")
    suppliers = events.where("kind NOT IN (5, 6)").select(
        "event_id", op.alias("op"), column.alias("op_column"), F.col("who").alias("s_suppkey"),
        F.col("part").alias("s_partkey"), F.col("nick").alias("s_nick"),
    )
    parts = events.where("kind IN (5, 6)").select(
        "event_id", op.alias("op"), F.lit(None).cast("string").alias("op_column"), F.col("part").alias("p_partkey")
    )
    tables = {
        "supplier": read(spark, folder, "supplier").selectExpr(
            "CAST(s_suppkey AS BIGINT) AS s_suppkey", "CAST(s_nationkey + 1 AS BIGINT) AS s_partkey", "CAST(s_suppkey AS BIGINT) AS s_nick"
        ),
        "part": read(spark, folder, "part").selectExpr("CAST(p_partkey AS BIGINT) AS p_partkey"),
    }
    specs = {"supplier": _NICKED, "part": _PARTS}
    return change_log.apply_log(tables, {"supplier": suppliers, "part": parts}, specs, "event_id")


@query(_LOG)
def apply_log(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every operation of a log over suppliers and parts."""
    return _log(spark, folder).outcomes
