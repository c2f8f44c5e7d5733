"""Batches of inserts, updates, NULLs and deletes as DataFrame-to-DataFrame functions.

A batch is checked against the table as it was before the batch, and then against earlier accepted
rows of the same batch.  Rows that break a rule come back with a reason; they never abort the job.
``outcomes`` says of every batch row what became of it: accepted, superseded by a later change of its key,
unknown key, or rejected with a reason.  The batch is read once for its marks, which are stored with ``session.durable``, and once
for the results.  Write a result to a new path: a plan must not overwrite the files it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayspark.model import Check, ForeignKey, TableSpec, children_of
from stayspark.operators import quality
from stayspark.operators.change_log import doubled
from stayspark.operators.joins import keys_among
from stayspark.operators.unions import union_all
from stayspark.session import durable, in_rounds


class Applied(NamedTuple):
    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    outcomes: DataFrame


def _outcome(reason: Column, *others: tuple[Column, str]) -> Column:
    """The reason comes first, then the others in order."""
    found = F.when(reason.isNotNull(), "rejected")
    for condition, name in others:
        found = found.when(condition, name)
    return found.otherwise("accepted")


def _same_types(found: DataFrame, wanted: Mapping[str, str]) -> None:
    """A value of another type would change the type of the whole column."""
    kinds = dict(found.dtypes)
    wrong = {c: kinds[c] for c, kind in wanted.items() if kinds[c] != kind}
    if wrong:
        raise ValueError(f"expected {({c: wanted[c] for c in wrong})}, got {wrong}")


def fails(check: Check) -> Column:
    return F.expr(quality.fails(check))


def _first_reason(*reasons: Column) -> Column:
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def _present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _flag(staged: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``_hit``: whether the row's key is among ``keys`` (unique on ``on``)."""
    return staged.join(keys.withColumn("_hit", F.lit(True)), list(on), "left")


def _mark_orphans(
    staged: DataFrame, fk: ForeignKey, parent: DataFrame, on: Sequence[str] = ()
) -> DataFrame:
    """``on`` names the batch columns that hold the foreign key, when they are called differently."""
    on = on or fk.columns
    present = parent.select(
        *[F.col(p).alias(c) for p, c in zip(fk.parent_columns, on, strict=True)]
    )
    keys = keys_among(present, staged.select(*on).distinct())
    orphan = _present(on) & F.col("_hit").isNull()
    return (
        _flag(staged, keys, on)
        .withColumn("reason", _first_reason("reason", F.when(orphan, f"foreign_key {fk.name}")))
        .drop("_hit")
    )


def _mark_taken(staged: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    keys = keys_among(table.select(*key), staged.select(*key).distinct())
    reason = F.when(F.col("_hit"), f"duplicate {','.join(key)}")
    return (
        _flag(staged, keys, key)
        .withColumn("reason", _first_reason("reason", reason))
        .drop("_hit")
    )


def _first_per_key(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    return (
        rows.where(_present(key)).groupBy(*key).agg(F.min(order).alias(order)).select(order, *key)
    )


def _admit(valid: DataFrame, rules: Sequence[Sequence[str]], order: str) -> DataFrame:
    """The rows that inserting one by one, in order, would let in: the ``order`` values.

    With one rule that is the first row of every key.  With several, a row that loses on one key
    must not block another row on its other key.  Each round admits every row that comes first on
    all its keys and drops the rows that share a key with it.  A row with exactly one earlier pending row among those it shares
    a key with gets in exactly if that one does not; chains of such rows are followed by pointer doubling,
    so that a round decides all of a chain that begins at an admitted row.  The earliest pending row is always admitted, so the
    rounds end, and the outcome is the one-by-one outcome exactly.

    Stored results: one per round, and in a round with chains the logarithm of the longest.  The rounds grow with the
    longest chain of rows that each have two or more undecided rows before them.
    """
    if len(rules) == 1:
        return _first_per_key(valid, rules[0], order).select(order)
    columns = list(dict.fromkeys(c for rule in rules for c in rule))
    with in_rounds(valid.sparkSession) as store:
        admitted = _admitted(store(valid.select(order, *columns)), rules, order, store)
        return durable(admitted) if admitted is not None else valid.select(order).limit(0)


def _rivals(pending: DataFrame, rules: Sequence[Sequence[str]], order: str) -> DataFrame:
    """``pending`` with ``_earlier``, the one earlier row that shares a key with it (null: none), and ``_more``, if there are more."""
    rows = pending
    for i, rule in enumerate(rules):
        first = _first_per_key(pending, rule, order).withColumnRenamed(order, f"_first{i}")
        rows = rows.join(first, list(rule), "left")
    for i, rule in enumerate(rules):
        later = rows.where(F.col(order) > F.col(f"_first{i}"))
        second = _first_per_key(later.select(order, *rule), rule, order).withColumnRenamed(order, f"_second{i}")
        rows = rows.join(second, list(rule), "left")
    ahead = [F.when(F.col(order) > F.col(f"_first{i}"), F.col(f"_first{i}")) for i in range(len(rules))]
    crowd = [F.coalesce(F.col(order) > F.col(f"_second{i}"), F.lit(False)) for i in range(len(rules))]
    names = F.array_distinct(F.array_compact(F.array(*ahead)))
    more = reduce(lambda a, b: a | b, crowd, F.size(names) > 1)
    return rows.select(*pending.columns, F.get(names, 0).alias("_earlier"), more.alias("_more"))


def _admitted(
    pending: DataFrame, rules: Sequence[Sequence[str]], order: str, store: Callable[[DataFrame], DataFrame]
) -> DataFrame | None:
    admitted = []
    while True:
        marked = store(_rivals(pending, rules, order))
        free = F.col("_earlier").isNull()
        if marked.where(free).isEmpty():
            break
        single = ~free & ~F.col("_more")
        judged = marked.select(
            F.col(order).alias("at"), F.when(single, F.col("_earlier")).alias("hangs_on"), F.lit(True).alias("flip"),
            F.when(free, F.lit(True)).alias("ok"),
        )
        won = F.when(free, F.lit(True))
        if not marked.where(single).isEmpty():
            followed = doubled(judged, store).toDF("_at", "_implied")
            marked = marked.join(followed, F.col(order) == F.col("_at"), "left")
            won = F.coalesce(won, "_implied")
        marked = store(marked.select(*pending.columns, won.alias("_won")))
        winners = marked.where("_won")
        admitted.append(winners.select(order))
        pending = marked.where("_won IS NULL").drop("_won")
        for rule in rules:
            taken = winners.where(_present(rule)).select(*rule)
            pending = pending.join(taken, list(rule), "left_anti")
        pending = store(pending)
    return union_all(admitted)


def insert_rows(
    table: DataFrame,
    batch: DataFrame,
    spec: TableSpec,
    order: str,
    parents: Mapping[str, DataFrame] | None = None,
) -> Applied:
    """Append the rows of a batch that break no rule.

    ``batch`` has the table's columns, in order and of the same types, plus ``order``: a unique column
    that says which row comes first.  ``rejected`` is the batch row with its first ``reason``.
    """
    if batch.columns != [*table.columns, order]:
        raise ValueError(f"{spec.name} expects {[*table.columns, order]}, got {batch.columns}")
    _same_types(batch, dict(table.dtypes))
    nulls = [F.when(F.col(c).isNull(), f"not_null {c}") for c in spec.required]
    checks = [F.when(fails(c), f"check {c.name}") for c in spec.checks]
    # Only keys travel through the rule joins; the rows come back in by their order at the end.
    keys = [c for fk in spec.foreign_keys for c in fk.columns]
    keys += [c for key in spec.unique_rules for c in key]
    staged = durable(
        batch.select(order, *dict.fromkeys(keys), _first_reason(*nulls, *checks).alias("reason"))
    )
    for fk in spec.foreign_keys:
        staged = _mark_orphans(staged, fk, (parents or {})[fk.parent])
    for key in spec.unique_rules:
        staged = _mark_taken(staged, table, key)
    # Admission and every result below read the marks: computed once.
    staged = durable(staged)
    first = _admit(staged.where(F.col("reason").isNull()), spec.unique_rules, order)
    late = F.when(F.col("_in").isNull(), "duplicate in batch")
    marks = staged.join(first.withColumn("_in", F.lit(True)), order, "left").select(
        order, _first_reason("reason", late).alias("reason")
    )
    rows = batch.join(marks, order)
    accepted = rows.where(F.col("reason").isNull()).select(*table.columns)
    rejected = rows.where(F.col("reason").isNotNull()).select(*batch.columns, "reason")
    outcomes = marks.select(order, _outcome(F.col("reason")).alias("outcome"), "reason")
    return Applied(table.unionByName(accepted), accepted, rejected, outcomes)


def _referenced(
    children: Sequence[tuple[DataFrame, str]], name: str, wanted: DataFrame
) -> DataFrame:
    """The wanted parent keys that some child row points at."""
    refs = union_all(child.select(F.col(c).alias(name)) for child, c in children)
    return keys_among(refs, wanted)


def update_rows(
    table: DataFrame,
    changes: DataFrame,
    spec: TableSpec,
    key: str,
    column: str,
    order: str,
    parents: Mapping[str, DataFrame] | None = None,
    children: Sequence[tuple[DataFrame, str]] | None = None,
) -> Applied:
    """Set ``column`` to ``value`` in every row where ``key`` equals the change's key.

    ``changes`` has the columns ``order`` (unique), ``key`` and ``value``, of the columns' types.  The
    last valid change of a key wins, the others are superseded.  A change without a key is rejected; one
    whose key has no row is reported as unknown, unless its value breaks a rule.  Where a check ties
    the new value to other columns and ``key`` is not the primary key, the last change of the key is
    the one tested, and it is refused as a whole if any of its rows would fail.  Changing a primary
    key takes ``children``, as ``delete_rows`` does.
    """
    spec.column(key), spec.column(column)
    if sorted(changes.columns) != sorted([order, key, "value"]):
        raise ValueError(f"changes need the columns {order}, {key} and value")
    kinds = dict(table.dtypes)
    _same_types(changes, {key: kinds[key], "value": kinds[column]})
    by_primary_key = spec.primary_key == (key,)
    batch = changes.select(order, key, "value")
    new = batch.withColumn(column, F.col("value")) if column != key else batch
    own = [c for c in spec.checks if c.columns == (column,)]
    tied = [c for c in spec.checks if column in c.columns and c not in own]

    reasons = [F.when(F.col(key).isNull(), f"not_null {key}")]
    if column in spec.required:
        reasons.append(F.when(F.col("value").isNull(), f"not_null {column}"))
    if column != key:
        reasons += [F.when(fails(c), f"check {c.name}") for c in own]
    staged = durable(
        new.withColumn("reason", _first_reason(*reasons)).select(order, key, "value", "reason")
    )
    asked = staged.select(key).distinct()
    others = list(dict.fromkeys(c for t in tied for c in t.columns if c not in (column, key)))
    if tied and by_primary_key:
        # One table row per change at most, so every change can be tested on its own row.
        known = table.select(key, *others).join(asked, key, "left_semi")
    else:
        known = keys_among(table.select(key), asked)
    staged = staged.join(known.withColumn("_known", F.lit(True)), key, "left")
    if tied and by_primary_key:
        staged = staged.withColumn(column, F.col("value"))
        broken = F.coalesce(*[F.when(F.col("_known") & fails(c), f"check {c.name}") for c in tied])
    else:
        broken = F.lit(None).cast("string")
    staged = staged.select(order, key, "value", "reason", "_known", broken.alias("_broken"))
    for fk in spec.foreign_keys:
        if fk.columns == (column,):
            staged = _mark_orphans(staged, fk, (parents or {})[fk.parent], on=["value"])
    if column in spec.primary_key:
        if not by_primary_key:
            raise ValueError("a primary key can only be changed by primary key")
        children = _declared_children(spec, children)
        if children:
            staged = _flag(staged, _referenced(children, key, asked), [key])
            staged = staged.withColumn(
                "reason", _first_reason("reason", F.when(F.col("_hit"), "referenced"))
            ).drop("_hit")
    if any(column in rule for rule in spec.unique_rules):
        staged = _mark_value_conflicts(staged, table, spec, key, column, order)
    staged = durable(
        staged.withColumn("reason", _first_reason("reason", "_broken")).drop("_broken")
    )

    valid = staged.where(F.col("reason").isNull())
    last = valid.groupBy(key).agg(
        F.max_by("value", order).alias("value"),
        F.max(order).alias(order),
        F.max("_known").alias("_known"),
    )
    if tied and not by_primary_key:
        touched = table.select(*dict.fromkeys([*spec.primary_key, key, *others])).join(
            last.select(key, "value"), key
        )
        any_broken = reduce(lambda a, b: a | b, [fails(c) for c in tied])
        touched = touched.withColumn(column, F.col("value"))
        refused = touched.where(any_broken).select(key).distinct().withColumn("_no", F.lit(True))
        losers = last.join(refused, key, "left_semi").select(order).withColumn("_no", F.lit(True))
        last = last.join(refused, key, "left_anti")
        staged = (
            staged.join(losers, order, "left")
            .withColumn("reason", _first_reason("reason", F.when(F.col("_no"), f"check {tied[0].name}")))
            .drop("_no")
        )
    last = last.withColumn("_set", F.lit(True))
    updated = table.join(last.select(key, "value", "_set"), key, "left").withColumn(
        column, F.when(F.col("_set"), F.col("value")).otherwise(F.col(column))
    )
    accepted = last.where("_known").select(order, key, "value")
    rejected = staged.where(F.col("reason").isNotNull()).select(order, key, "value", "reason")
    outcome = _outcome(
        F.col("reason"),
        (F.col("_known").isNull(), "unknown key"),
        (F.col("_set").isNull(), "superseded"),
    )
    outcomes = staged.join(last.select(order, "_set"), order, "left").select(
        order, key, outcome.alias("outcome"), "reason"
    )
    return Applied(updated.select(*table.columns), accepted, rejected, outcomes)


def _declared_children(
    spec: TableSpec, children: Sequence[tuple[DataFrame, str]] | None
) -> list[tuple[DataFrame, str]]:
    """The given children; every foreign key that the model points at the table must be among them."""
    if children is None:
        raise ValueError(f"say which tables point at {spec.name}, or that none does")
    wanted = sorted(fk.columns[0] for _, fk in children_of(spec.name))
    given = sorted(column for _, column in children)
    if len(given) < len(wanted) or any(given.count(c) < wanted.count(c) for c in wanted):
        raise ValueError(f"{spec.name} is referenced by {wanted}, got {given}")
    return list(children)


def _mark_value_conflicts(
    staged: DataFrame, table: DataFrame, spec: TableSpec, key: str, column: str, order: str
) -> DataFrame:
    """Refuse a value that another row already has, that one change would write to several rows,
    or that an earlier valid change of the batch claims for another key."""
    rule = next(r for r in spec.unique_rules if column in r)
    if rule != (column,):
        raise ValueError(f"{column!r} belongs to a composite unique key")
    reason = f"duplicate {column}"
    holders = table.select(F.col(column).alias("value"), F.col(key).alias("_holder")).join(
        staged.select("value").distinct(), "value", "left_semi"
    )
    other = F.col("_holder").isNotNull() & (F.col("_holder") != F.col(key))
    staged = (
        staged.join(holders, "value", "left")
        .withColumn("reason", _first_reason("reason", F.when(other, reason)))
        .drop("_holder")
    )
    if spec.primary_key != (key,):
        counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        asked = staged.select(key).distinct()
        many = counts.join(asked, key, "left_semi").where("_n > 1").select(key)
        several = F.col("_hit") & F.col("value").isNotNull()
        staged = (
            _flag(staged, many, [key])
            .withColumn("reason", _first_reason("reason", F.when(several, reason)))
            .drop("_hit")
        )
    staged = durable(staged)
    good = F.col("reason").isNull() & F.col("_broken").isNull() & F.col("value").isNotNull()
    owners = staged.where(good).groupBy("value").agg(F.min_by(key, order).alias("_owner"))
    claimed = F.col("_owner").isNotNull() & (F.col("_owner") != F.col(key))
    return (
        staged.join(owners, "value", "left")
        .withColumn("reason", _first_reason("reason", F.when(claimed, reason)))
        .drop("_owner")
    )


def null_values(
    table: DataFrame,
    keys: DataFrame,
    spec: TableSpec,
    key: str,
    column: str,
    order: str,
) -> Applied:
    """Set ``column`` to NULL in every row whose ``key`` is among the keys."""
    kind = table.schema[column].dataType
    changes = keys.select(order, key, F.lit(None).cast(kind).alias("value"))
    return update_rows(table, changes, spec, key, column, order)


def delete_rows(
    table: DataFrame,
    keys: DataFrame,
    spec: TableSpec,
    key: str,
    children: Sequence[tuple[DataFrame, str]],
) -> Applied:
    """Delete every row whose ``key`` is among the keys.

    A key is refused as a whole when a child row still points at one of its rows; ``children`` are
    (child table, foreign-key column) pairs, and all that the model knows must be given.
    ``accepted`` and ``rejected`` hold distinct keys.  ``outcomes`` has each asked key with what became of
    it and how many ``requests`` named it, the null key included.
    """
    spec.column(key)
    _same_types(keys, {keys.columns[0]: dict(table.dtypes)[key]})
    children = _declared_children(spec, children)
    asked = durable(
        keys.groupBy(F.col(keys.columns[0]).alias(key)).agg(F.count(F.lit(1)).alias("requests"))
    )
    wanted = asked.where(F.col(key).isNotNull()).select(key)
    known = keys_among(table.select(key), wanted)
    blocked = wanted.limit(0)
    if children:
        (primary,) = spec.primary_key
        if primary == key:
            blocked = _referenced(children, primary, wanted)
        else:
            hit = table.select(primary, key).join(wanted, key, "left_semi")
            referenced = _referenced(children, primary, hit.select(primary))
            blocked = hit.join(referenced, primary, "left_semi").select(key).distinct()
    marked = asked.join(known.withColumn("_known", F.lit(True)), key, "left").join(
        blocked.withColumn("_no", F.lit(True)), key, "left"
    )
    reason = F.when(F.col(key).isNull(), f"not_null {key}").when(F.col("_no"), "referenced")
    marked = durable(marked.select(key, "requests", "_known", reason.alias("reason")))
    unknown = F.col("_known").isNull()
    allowed = marked.where(F.col("reason").isNull() & ~unknown).select(key)
    remaining = table.join(allowed, key, "left_anti").select(*table.columns)
    rejected = marked.where("reason = 'referenced'").select(key, "reason")
    outcomes = marked.select(
        key, _outcome(F.col("reason"), (unknown, "unknown key")).alias("outcome"), "reason", "requests"
    )
    return Applied(remaining, allowed, rejected, outcomes)
