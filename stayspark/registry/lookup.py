"""Look-ups, distinct values, profiles, fingerprints and new keys over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.functions.numbers import money
from stayspark.functions.parsing import parse_name
from stayspark.operators import ids, lookup
from stayspark.operators.unions import union_all
from stayspark.registry.base import invoices, query, read, sql_money

# The given tables and their columns.
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority",
    ),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def lookup_value(spark: SparkSession, folder: str) -> DataFrame:
    found = lookup.rows_where(read(spark, folder, "orders"), "o_orderpriority", "1-URGENT")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_custkey IN (SELECT user_id FROM events)"""
)
def lookup_keys(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    keys = read(spark, folder, "events").select("user_id")
    return lookup.rows_with_keys(orders, "o_custkey", keys)


@query(
    """SELECT DISTINCT CAST(d.doc_id AS VARCHAR) AS key, l.doc_id IS NOT NULL AS found
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def known_keys(spark: SparkSession, folder: str) -> DataFrame:
    typed = read(spark, folder, "documents").select(
        F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\t")).alias("typed")
    )
    return lookup.known_keys(read(spark, folder, "labels"), "doc_id", typed, "typed")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS key FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    return known_keys(spark, folder).where(~F.col("found")).select("key")


@query(
    """SELECT CASE WHEN event_type <> 'view' THEN upper(event_type[1]) || event_type[2:] END
  AS name, count(*) AS asked FROM events GROUP BY 1"""
)
def typed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names typed in any casing, against a list that lacks one of them."""
    typed = F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))
    name = parse_name(typed, ("Click", "Error", "Purchase", "Signup"))
    events = read(spark, folder, "events")
    return events.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("asked"))


@query(
    f"""SELECT 2 * event_id AS "BookingBookingID", o_orderkey AS "InvoiceID",
  {sql_money("CAST(o_totalprice AS DECIMAL(18,2))")} AS "Amount", o_orderkey IS NOT NULL AS found
FROM events LEFT JOIN orders ON o_orderkey = 2 * event_id"""
)
def invoice_lookup(spark: SparkSession, folder: str) -> DataFrame:
    asked = read(spark, folder, "events").select((2 * F.col("event_id")).alias("booking"))
    answered = lookup.invoices_for(asked, invoices(spark, folder))
    return answered.withColumn("Amount", money(F.col("Amount")))


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.distinct_values(read(spark, folder, "orders"), "o_orderpriority")


@query(
    """SELECT l_returnflag, count(*) AS line_count, CAST(sum(l_linenumber) AS BIGINT) AS numbers
FROM lineitem WHERE l_linenumber >= 3 AND l_linestatus = 'O' GROUP BY l_returnflag"""
)
def parameterised_query(spark: SparkSession, folder: str) -> DataFrame:
    """SQL text with bound values: they never become part of the text."""
    return spark.sql(
        """SELECT l_returnflag, count(*) AS line_count, sum(l_linenumber) AS numbers
           FROM {lines} WHERE l_linenumber >= :first AND l_linestatus = :status
           GROUP BY l_returnflag""",
        args={"first": 3, "status": "O"},
        lines=read(spark, folder, "lineitem"),
    )


_PROFILE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count,
  count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {t}"""
    for t, columns in COLUMNS.items()
    for c in columns
)


@query(_PROFILE_SQL)
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.profile(
        {t: read(spark, folder, t).select(*columns) for t, columns in COLUMNS.items()}
    )


# Columns that the engines would write as different text.
_DOUBLES = {
    "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "value",
}
_TIMES = {"o_orderdate", "l_shipdate", "ts"}


def _double(value: str) -> str:
    """A double as two whole numbers: multiples of 2**-20, and of 2**-52 what is left."""
    shifted = f"{value} * 1048576"
    rest = f"({shifted} - floor({shifted})) * 4294967296"
    parts = [f"CAST(CAST(floor({part}) AS BIGINT) AS {{text}})" for part in (shifted, rest)]
    return f"concat({parts[0]}, '.', {parts[1]})"


def _cell(column: str, sql: bool) -> str:
    """A column as text that holds its length, or a mark for NULL, in either engine."""
    if column in _DOUBLES:
        text = _double(column)
    elif column in _TIMES:
        day = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')" if sql else "date_format({}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        text = day.format(column)
    elif column == "embedding":
        item = _double("CAST(x AS DOUBLE)")
        text = (
            f"array_to_string(list_transform(embedding, lambda x: {item}), ',')"
            if sql
            else f"array_join(transform(embedding, x -> {item}), ',')"
        )
    else:
        text = f"CAST({column} AS {{text}})"
    text = text.replace("{text}", "VARCHAR" if sql else "STRING")
    whole = f"concat('v', CAST(length({text}) AS {'VARCHAR' if sql else 'STRING'}), ':', {text})"
    return f"CASE WHEN {column} IS NULL THEN 'n' ELSE {whole} END"


def _fingerprint_sql(table: str, columns) -> str:
    listed = ", ".join(_cell(c, sql=True) for c in columns)
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count,
  CAST(sum(CAST('0x' || substr(md5(concat({listed})), 1, 15) AS BIGINT)) AS DECIMAL(38,0))
    AS content_sum FROM {table}"""


@query("\nUNION ALL\n".join(_fingerprint_sql(t, c) for t, c in COLUMNS.items()))
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Content sums of all given tables, by a digest that every engine has."""
    parts = []
    for name, columns in COLUMNS.items():
        text = F.concat(*[F.expr(_cell(c, sql=False)) for c in columns])
        digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10)
        part = lookup.fingerprint(read(spark, folder, name), digest)
        parts.append(part.select(F.lit(name).alias("table_name"), "*"))
    return union_all(parts)


@query(
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{change}' AS change, count(*) AS row_count, {change == 'dealt'} AS same FROM {t}"
        for t in COLUMNS
        for change in ("dealt", "blanked")
    )
)
def table_fingerprint_fast(spark: SparkSession, folder: str) -> DataFrame:
    """The default hash exists in Spark only: every table against itself dealt out otherwise, and against itself
    with a cell of the first row blanked."""
    parts = []
    for name, (key, cell, *_) in COLUMNS.items():
        table = read(spark, folder, name)
        first = table.where(F.col(cell).isNotNull()).agg(F.min(key)).first()[0]
        blanked = table.withColumn(cell, F.when(F.col(key) != first, F.col(cell)))
        for change, other in (("dealt", lookup.dealt_out(table)), ("blanked", blanked)):
            same = lookup.same_content(table, other)
            parts.append(same.select(F.lit(name).alias("table_name"), F.lit(change).alias("change"), "*"))
    return union_all(parts)


_NEXT_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id"}


@query(
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(coalesce(max({k}), 0) + 1 AS BIGINT) AS next_key FROM {t}"
        for t, k in _NEXT_KEYS.items()
    )
)
def next_ids(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        ids.next_key(read(spark, folder, t), k).select(F.lit(t).alias("table_name"), "next_key")
        for t, k in _NEXT_KEYS.items()
    ]
    return union_all(parts)


@query(
    """SELECT event_id, (SELECT coalesce(max(c_custkey), 0) FROM customer)
  + row_number() OVER (ORDER BY event_id) AS c_custkey FROM events"""
)
def batch_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select("event_id")
    return ids.with_new_keys(rows, read(spark, folder, "customer"), "c_custkey", "event_id")
