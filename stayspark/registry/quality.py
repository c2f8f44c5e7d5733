"""Rule checks over the given tables, against the rules they might be declared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.model import Check, ForeignKey, TableSpec
from stayspark.operators import quality
from stayspark.operators.unions import union_all
from stayspark.registry.base import query, read


def _fk(column: str, parent: str, parent_column: str) -> ForeignKey:
    return ForeignKey((column,), parent, (parent_column,))


SPECS = {
    s.name: s
    for s in (
        TableSpec("region", ("r_regionkey",)),
        TableSpec("nation", ("n_nationkey",), foreign_keys=(_fk("n_regionkey", "region", "r_regionkey"),)),
        TableSpec(
            "customer",
            ("c_custkey",),
            not_null=("c_name", "c_nationkey"),
            checks=(Check("c_balance", "c_acctbal >= 0", ("c_acctbal",)),),
            foreign_keys=(
                _fk("c_nationkey", "nation", "n_nationkey"),
                _fk("c_custkey", "events", "user_id"),
            ),
        ),
        TableSpec(
            "supplier",
            ("s_suppkey",),
            not_null=("s_name", "s_nationkey"),
            checks=(Check("s_balance", "s_acctbal >= 0", ("s_acctbal",)),),
            unique=(("s_nationkey",),),
            foreign_keys=(_fk("s_nationkey", "nation", "n_nationkey"),),
        ),
        TableSpec(
            "part",
            ("p_partkey",),
            checks=(Check("p_size_range", "p_size BETWEEN 1 AND 25", ("p_size",)),),
        ),
        TableSpec(
            "orders",
            ("o_orderkey",),
            not_null=("o_custkey", "o_orderdate"),
            checks=(Check("o_status", "o_orderstatus IN ('F', 'O')", ("o_orderstatus",)),),
            unique=(("o_custkey",),),
            foreign_keys=(
                _fk("o_custkey", "customer", "c_custkey"),
                _fk("o_custkey", "supplier", "s_suppkey"),
            ),
        ),
        TableSpec(
            "lineitem",
            ("l_orderkey", "l_linenumber"),
            checks=(
                Check("l_quantity_limit", "l_quantity <= 45", ("l_quantity",)),
                Check("l_flag", "l_returnflag IN ('A', 'N')", ("l_returnflag",)),
            ),
            foreign_keys=(
                _fk("l_orderkey", "orders", "o_orderkey"),
                _fk("l_partkey", "part", "p_partkey"),
                _fk("l_suppkey", "supplier", "s_suppkey"),
                _fk("l_partkey", "customer", "c_custkey"),
            ),
        ),
        TableSpec("events", ("event_id",), foreign_keys=(_fk("user_id", "customer", "c_custkey"),)),
        # Documents with their label, where there is one: the label columns may be NULL.
        TableSpec(
            "labelled",
            ("doc_id",),
            not_null=("quality", "toxic"),
            checks=(Check("not_toxic", "toxic IN (0)", ("toxic",)),),
            unique=(("quality", "toxic"),),
            foreign_keys=(_fk("doc_id", "labels", "doc_id"),),
        ),
        TableSpec("labels", ("doc_id",), foreign_keys=(_fk("doc_id", "documents", "doc_id"),)),
        TableSpec("conversations", ("conv_id",), unique=(("conv_id", "turn"), ("role",))),
    )
}


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {n: read(spark, folder, n) for n in SPECS if n != "labelled"}
    tables["documents"] = read(spark, folder, "documents").select("doc_id", "lang")
    tables["labelled"] = tables["documents"].join(tables["labels"], "doc_id", "left")
    return tables


_LABELLED = """
WITH labelled AS (
  SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def _sql_text(columns) -> str:
    parts = [f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in columns]
    return " || '|' || ".join(parts)


def _sql_repeats(name: str, kind: str, columns) -> str:
    present = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""SELECT '{name}' AS table_name, '{kind}' AS kind, '{",".join(columns)}' AS rule,
  {_sql_text(columns)} AS key, count(*) AS row_count FROM {name} WHERE {present}
GROUP BY {", ".join(columns)} HAVING count(*) > 1"""


def _sql_rows(name: str, kind: str, rule: str, key, condition: str) -> str:
    return f"""SELECT '{name}' AS table_name, '{kind}' AS kind, '{rule}' AS rule,
  {_sql_text(key)} AS key, CAST(1 AS BIGINT) AS row_count FROM {name} WHERE {condition}"""


def _sql_orphans(name: str, fk: ForeignKey) -> str:
    (child,), (parent,) = fk.columns, fk.parent_columns
    return f"""SELECT '{name}' AS table_name, 'foreign_key' AS kind, '{fk.name}' AS rule,
  {_sql_text([f"c.{child}"])} AS key, count(*) AS row_count FROM {name} c
WHERE c.{child} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {fk.parent} p WHERE p.{parent} = c.{child})
GROUP BY c.{child}"""


def _sql(kind: str) -> str:
    parts = []
    for name, spec in SPECS.items():
        if kind == "primary_key":
            parts.append(_sql_repeats(name, kind, spec.primary_key))
        elif kind == "unique":
            parts += [_sql_repeats(name, kind, u) for u in spec.unique]
        elif kind == "not_null":
            parts += [
                _sql_rows(name, kind, c, spec.primary_key, f"{c} IS NULL") for c in spec.not_null
            ]
        elif kind == "check":
            parts += [
                _sql_rows(name, kind, c.name, spec.primary_key, f"NOT ({c.predicate})")
                for c in spec.checks
            ]
        else:
            parts += [_sql_orphans(name, fk) for fk in spec.foreign_keys]
    return "\nUNION ALL\n".join(parts)


@query(_LABELLED + _sql("primary_key"))
def pk_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    return union_all(quality.primary_key_violations(tables[n], s) for n, s in SPECS.items())


@query(_LABELLED + _sql("unique"))
def unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    return union_all(quality.unique_violations(tables[n], s) for n, s in SPECS.items())


@query(_LABELLED + _sql("not_null"))
def null_violations(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    return union_all(quality.row_violations(tables[n], s, ["not_null"]) for n, s in SPECS.items())


@query(_LABELLED + _sql("check"))
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    return union_all(quality.row_violations(tables[n], s, ["check"]) for n, s in SPECS.items())


@query(_LABELLED + _sql("foreign_key"))
def fk_orphans_all(spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder)
    return union_all(quality.foreign_key_violations(tables, s) for s in SPECS.values())


_KINDS = ("primary_key", "not_null", "check", "unique", "foreign_key")


@query(
    _LABELLED
    + "SELECT table_name, kind, rule, count(*) AS bad_keys, CAST(sum(row_count) AS BIGINT) AS bad_rows"
    + "\nFROM ("
    + "\nUNION ALL\n".join(_sql(k) for k in _KINDS)
    + ") GROUP BY table_name, kind, rule"
)
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    report = quality.violations(_tables(spark, folder), SPECS)
    return report.groupBy("table_name", "kind", "rule").agg(
        F.count(F.lit(1)).alias("bad_keys"), F.sum("row_count").alias("bad_rows")
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, first_order
FROM lineitem JOIN (SELECT l_returnflag, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_returnflag)
USING (l_returnflag) WHERE l_linestatus = 'O'"""
)
def rows_of_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows joined on a key of which three values hold everything; adaptive execution cuts them."""
    lines = read(spark, folder, "lineitem")
    first = lines.groupBy("l_returnflag").agg(F.min("l_orderkey").alias("first_order"))
    named = lines.where("l_linestatus = 'O'").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    return named.join(first, "l_returnflag")


@query(
    """SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey)"""
)
def orphan_order_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    events = read(spark, folder, "events")
    return quality.orphan_rows(orders, _fk("o_custkey", "events", "user_id"), events)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS arrival,
  CAST(l_shipdate AS DATE) AS checkout,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS nights
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE NOT (CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE))"""
)
def chronology_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items shipped on or before the order date, as rows."""
    lines = read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("checkout"),
    )
    arrivals = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("arrival")
    )
    dated = lines.join(arrivals, "l_orderkey")
    check = Check("checkout_after_arrival", "checkout > arrival", ("arrival", "checkout"))
    return dated.where(quality.fails(check)).withColumn(
        "nights", F.datediff("checkout", "arrival")
    )
