"""Rule checks that return the violating keys.

Every report has the same columns: table_name, kind, rule, key and row_count.  Key rules are
folded per key and input partition before any join, so a key that holds a third of the table costs one
report row and no hot task; row rules are a single narrow pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.model import Check, ForeignKey, TableSpec
from stayspark.operators.unions import union_all


# Rows whose keys a task holds at a time.
TASK_ROWS = 500_000


def key_text(columns: Sequence[str]) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS STRING), 'NULL')" for c in columns)
    return f"concat_ws('|', {parts})"


def _present(columns: Sequence[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _key_counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows carry each key, in as many tasks as there are rows for.

    A key is first counted for each input partition by itself, so no task gets all rows of a hot key.
    """
    tasks = table.count() // TASK_ROWS + 1
    parts = table.select(*columns, F.spark_partition_id().alias("_part")).repartition(tasks, *columns, "_part")
    folded = parts.groupBy(*columns, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    return folded.repartition(tasks, *columns).groupBy(*columns).agg(F.sum("_rows").alias("row_count"))


def _report(
    found: DataFrame, table: str, kind: str, rule: str, columns: Sequence[str]
) -> DataFrame:
    return found.selectExpr(
        f"'{table}' AS table_name",
        f"'{kind}' AS kind",
        f"'{rule}' AS rule",
        f"{key_text(columns)} AS key",
        "row_count",
    )


def repeated_keys(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; a key with a NULL part never repeats."""
    present = table.where(_present(columns))
    return _key_counts(present, columns).where("row_count > 1")


def primary_key_violations(table: DataFrame, spec: TableSpec) -> DataFrame:
    """Repeated keys, and keys with a NULL part however often they occur."""
    key = spec.primary_key
    bad = _key_counts(table, key).where(f"row_count > 1 OR NOT ({_present(key)})")
    return _report(bad, spec.name, "primary_key", ",".join(key), key)


def unique_violations(table: DataFrame, spec: TableSpec) -> DataFrame | None:
    parts = [
        _report(repeated_keys(table, key), spec.name, "unique", ",".join(key), key)
        for key in spec.unique
    ]
    return union_all(parts)


def fails(check: Check) -> str:
    """True only where the predicate is false: a NULL result passes, as in SQL."""
    return f"NOT coalesce({check.predicate}, TRUE)"


def row_violations(
    table: DataFrame, spec: TableSpec, kinds: Sequence[str] = ("not_null", "check")
) -> DataFrame | None:
    """One row per broken NOT NULL or CHECK rule of a row: a single pass without a shuffle."""
    marks = []
    if "not_null" in kinds:
        marks += [(f"{c} IS NULL", "not_null", c) for c in spec.not_null]
    if "check" in kinds:
        marks += [(fails(c), "check", c.name) for c in spec.checks]
    if not marks:
        return None
    any_bad = " OR ".join(bad for bad, _, _ in marks)
    broken = ", ".join(
        f"CASE WHEN {bad} THEN named_struct('kind', '{kind}', 'rule', '{rule}') END"
        for bad, kind, rule in marks
    )
    # Only violating rows are unfolded.
    return (
        table.where(any_bad)
        .selectExpr(f"{key_text(spec.primary_key)} AS key", f"explode(array({broken})) AS b")
        .where("b IS NOT NULL")
        .selectExpr(
            f"'{spec.name}' AS table_name",
            "b.kind AS kind",
            "b.rule AS rule",
            "key",
            "CAST(1 AS BIGINT) AS row_count",
        )
    )


def orphan_keys(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Foreign-key values without a parent, and how many child rows carry each.

    Both sides are folded to distinct keys first, and the join reuses that partitioning.
    """
    values = _key_counts(child.where(_present(fk.columns)), fk.columns)
    renamed = [f"{p} AS {c}" for p, c in zip(fk.parent_columns, fk.columns, strict=True)]
    present = parent.selectExpr(*renamed).distinct()
    return values.join(present, list(fk.columns), "left_anti")


def orphan_rows(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """The child rows themselves, for when the keys are not enough."""
    lost = orphan_keys(child, fk, parent).drop("row_count")
    return child.join(lost, list(fk.columns), "left_semi")


def foreign_key_violations(
    tables: Mapping[str, DataFrame], spec: TableSpec
) -> DataFrame | None:
    parts = [
        _report(
            orphan_keys(tables[spec.name], fk, tables[fk.parent]),
            spec.name,
            "foreign_key",
            fk.name,
            fk.columns,
        )
        for fk in spec.foreign_keys
    ]
    return union_all(parts)


def _common_types(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> list[str]:
    """The types in which a join would compare the columns of a foreign key with those of its parent."""
    own, other = dict(child.dtypes), dict(parent.dtypes)
    pairs = [(own[c], other[p]) for c, p in zip(columns, parent_columns, strict=True)]
    both = [f"coalesce(CAST(NULL AS {a}), CAST(NULL AS {b})) AS c{i}" for i, (a, b) in enumerate(pairs)]
    return [kind for _, kind in child.sparkSession.range(0).selectExpr(*both).dtypes]


def _slots(kinds: Sequence[str]) -> list[tuple[str, int]]:
    """A place for each part of a key: its type, and its number among the parts of that type."""
    return [(kind, list(kinds[:i]).count(kind)) for i, kind in enumerate(kinds)]


def violations(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> DataFrame:
    """Every broken rule of every table in one report; each table is read twice.

    One pass tests the rules of single rows.  The other unfolds each row to its keys: those of the table itself, and
    those that children and parents of a foreign key share.  All key rules are then counted together,
    and a foreign key is broken where its key has child rows but no parent row.

    Keys keep their types: a row of the unfolded keys has a column for each type that occurs, as often as one rule needs
    it, and a foreign key is compared in the type in which a join of both sides would be.
    """
    # Of each rule: table, kind, name, columns with their own types, and the places of its parts.
    rules: list[tuple] = []
    keys: dict[str, list[tuple]] = {name: [] for name in specs}
    for name, spec in specs.items():
        own = dict(tables[name].dtypes)
        for kind, columns in [("primary_key", spec.primary_key), *[("unique", key) for key in spec.unique]]:
            places = _slots([own[c] for c in columns])
            keys[name].append((len(rules), columns, places, False))
            rules.append((name, kind, ",".join(columns), [own[c] for c in columns], places))
        for fk in spec.foreign_keys:
            kinds = _common_types(tables[name], fk.columns, tables[fk.parent], fk.parent_columns)
            keys[name].append((len(rules), fk.columns, _slots(kinds), False))
            keys.setdefault(fk.parent, []).append((len(rules), fk.parent_columns, _slots(kinds), True))
            rules.append((name, "foreign_key", fk.name, [own[c] for c in fk.columns], _slots(kinds)))
    slots = sorted({place for *_, places in rules for place in places})
    held = {place: f"part_{i}" for i, place in enumerate(slots)}

    def entry(rule: int, columns: Sequence[str], places: list[tuple[str, int]], parent: bool) -> str:
        parts = dict(zip(places, columns, strict=True))
        cells = [f"CAST({parts.get(p, 'NULL')} AS {p[0]}) AS {held[p]}" for p in slots]
        hole = " OR ".join(f"{c} IS NULL" for c in columns)
        return f"struct({rule} AS rule_no, ({hole}) AS hole, {str(parent).lower()} AS parent, {', '.join(cells)})"

    unfolded = [
        tables[name].selectExpr(f"inline(array({', '.join(entry(*e) for e in listed)}))")
        for name, listed in keys.items()
        if listed
    ]
    counted = union_all(unfolded).groupBy("rule_no", "hole", *held.values()).agg(
        F.count_if(~F.col("parent")).alias("row_count"), F.max("parent").alias("parent")
    )
    spark = next(iter(tables.values())).sparkSession
    # As many rows as the model has key rules.
    named = spark.createDataFrame(
        [(i, *rule[:3]) for i, rule in enumerate(rules)], "rule_no int, table_name string, kind string, rule string"
    )
    broken = (
        F.when(F.col("kind") == "primary_key", (F.col("row_count") > 1) | F.col("hole"))
        .when(F.col("kind") == "unique", (F.col("row_count") > 1) & ~F.col("hole"))
        .otherwise((F.col("row_count") > 0) & ~F.col("hole") & ~F.col("parent"))
    )
    # The key as its own table writes it; only broken ones become text.
    texts = [
        f"WHEN {i} THEN " + key_text([f"CAST({held[p]} AS {kind})" for p, kind in zip(places, kinds, strict=True)])
        for i, (*_, kinds, places) in enumerate(rules)
    ]
    key = F.expr(f"CASE rule_no {' '.join(texts)} END")
    by_key = counted.join(F.broadcast(named), "rule_no").where(broken)
    report = by_key.select("table_name", "kind", "rule", key.alias("key"), "row_count")
    return union_all([report, *[row_violations(tables[n], s) for n, s in specs.items()]])


def schema_drift(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> DataFrame:
    """Differences between declared and found columns, by position; empty when there are none."""
    rows = []
    for name in sorted({*tables, *specs}):
        declared = specs[name].schema.fields if name in specs else []
        found = tables[name].schema.fields if name in tables else []
        for i in range(max(len(declared), len(found))):
            want = f"{declared[i].name} {declared[i].dataType.simpleString()}" if i < len(declared) else None
            have = f"{found[i].name} {found[i].dataType.simpleString()}" if i < len(found) else None
            if want != have:
                rows.append((name, i, want, have))
    return spark.createDataFrame(
        rows, "table_name string, position int, declared string, found string"
    )

