"""One ordered log of inserts, updates and deletes over several tables, with the outcome of entering them one by one.

Whether an operation is accepted depends on earlier ones only: is its row there, is the parent there, does a child
still point at the row, does another row hold the value.  All of these are counts that go up and down along the log:
of rows per key, of references per parent, of holders per value.  So, given a guess of which operations are accepted, every
operation is judged by sums over the earlier events of the keys it asks about (``operators.scans``), which turns one
guess into the next.  The right outcome is the only guess that stays as it is.

Decisions hang on one another in long webs: thousands deep where some million operations share few keys.  Where the keys that
an operation asks about stand in the log itself, no guess is needed: the log is entered in windows of consecutive operations,
one after the other.  For each one the counts and values that its operations ask about are gathered from the stored tables and from what
earlier windows changed, over all tasks; one task then enters the window's operations one by one.  Every operation is entered once.

Rules over several columns, such as a composite UNIQUE key, ask about values that depend on earlier outcomes.  There each round
deals the log out in slices of consecutive operations, of which each task enters its own one by one, from the counts and
values that the guess gives for the slice's start.  Every round settles at least one more slice.

Long chains that run through many slices, such as a value that is handed on from row to row, are not followed slice by slice:
an operation with one open question points at the operation that answers it, and pointers are doubled along the chain.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayspark.model import TableSpec
from stayspark.operators import quality
from stayspark.operators.scans import running
from stayspark.operators.unions import union_all
from stayspark.session import durable, in_rounds, scratch_folder

OPS = ("insert", "update", "delete")
# Events of one key that a task may sort; beyond that they are spread over tasks.
SMALL = 100_000
# Operations that a task enters one by one, starting from a guess.
SLICE = 100_000
# Operations that a task enters one by one where what they ask about is known.
WINDOW = 500_000
# Files in which the operations of a window are stored.
FILES = 4
# Windows after which what they changed is folded into one state.
RUNS = 16
# Every so many rounds chains are followed by doubling; short ones end before.
PATIENCE = 4
# The place of a column that is not followed.
OTHER = -2
# Reasons in the order in which they are reported; rules of one kind by their place in the model.
MISSING, CHECK, PARENT, ROW, TIED, TAKEN, REFERENCED = range(1000, 8000, 1000)


class Logged(NamedTuple):
    tables: dict[str, DataFrame]
    outcomes: DataFrame


class _Rules(NamedTuple):
    """What entering an operation on a table asks and changes; columns by their place among the followed ones, -1: the key."""

    name: str
    duplicate: str
    fks: list[tuple[str, tuple[int, ...], int, str]]
    uniques: list[tuple[str, tuple[int, ...], int, str]]
    parent_of: bool


def _key(*parts: Column) -> Column:
    """Values of any type as one text; null where a part is null."""
    text = F.lit("")
    for part in parts:
        value = part.cast("string")
        text = F.concat(text, F.length(value).cast("string"), F.lit(":"), value)
    return text


def _failing(priority: int, bad: Column, reason: str) -> Column:
    return F.when(bad, F.struct(F.lit(priority).alias("priority"), F.lit(reason).alias("reason")))


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class _Table:
    """The operations on one table: which columns must be followed, and what each operation asks and changes."""

    def __init__(self, name: str, table: DataFrame, log: DataFrame, specs: Mapping[str, TableSpec], order: str):
        self.name, self.table, self.order, self.spec = name, table, order, specs[name]
        (self.pk,) = self.spec.primary_key
        for fk in self.spec.foreign_keys:
            if fk.parent_columns != specs[fk.parent].primary_key or fk.parent == name:
                raise ValueError(f"{fk.name}: only a key of another table can be followed")
        if sorted(log.columns) != sorted([order, "op", "op_column", *table.columns]):
            raise ValueError(f"{name} expects {[order, 'op', 'op_column', *table.columns]}, got {log.columns}")
        self.kinds = dict(table.dtypes)
        wrong = {c: k for c, k in log.dtypes if c in self.kinds and k != self.kinds[c]}
        if wrong:
            raise ValueError(f"{name} has other types than {wrong}")
        self.tied = [c for c in self.spec.checks if len(c.columns) > 1]
        self.unique = [u for u in self.spec.unique if u != (self.pk,)]
        followed = [c for fk in self.spec.foreign_keys for c in fk.columns]
        followed += [c for u in self.unique for c in u] + [c for t in self.tied for c in t.columns]
        self.followed = [c for c in dict.fromkeys(followed) if c != self.pk]
        self.parent_of = any(fk.parent == name for s in specs.values() for fk in s.foreign_keys)
        self.insert, self.update, self.delete = (F.col("op") == op for op in OPS)
        base = table.select(self.pk, *[F.col(c).alias(f"_base_{c}") for c in self.followed])
        # Rows with keys of the log; what an operation needs of its own row is joined on once.
        asked = log.select(self.pk).distinct()
        base = base.join(asked, self.pk, "left_semi")
        self.log = durable(
            log.join(base, self.pk, "left").select(
                order, "op", "op_column", *table.columns, *[f"_base_{c}" for c in self.followed],
                self._static().alias("static"),
            )
        )

    def writes(self, column: str) -> Column:
        """Whether an operation, if accepted, writes the column."""
        return self.insert | (self.update & (F.col("op_column") == column))

    def _static(self) -> Column:
        """The first rule that the operation breaks by itself."""
        known = F.col("op_column").isin([c for c in self.table.columns if c != self.pk])
        bad = [
            _failing(MISSING, F.col(self.pk).isNull(), f"not_null {self.pk}"),
            _failing(MISSING, ~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown op"),
            _failing(MISSING, self.update & ~F.coalesce(known, F.lit(False)), "unknown column"),
        ]
        bad += [_failing(MISSING, self.writes(c) & F.col(c).isNull(), f"not_null {c}") for c in self.spec.required]
        for check in self.spec.checks:
            asked = self.insert if check in self.tied else self.writes(check.columns[0])
            bad.append(_failing(CHECK, asked & F.expr(quality.fails(check)), f"check {check.name}"))
        return F.coalesce(*bad)

    def mentions(self) -> list[tuple[str, Column]]:
        """The columns whose values name keys, as far as they can be told before the outcome."""
        found = [(f"row {self.name}", F.col(self.pk))]
        for fk in self.spec.foreign_keys:
            found += [(f"row {fk.parent}", F.col(c)) for c in (*fk.columns, *(f"_base_{c}" for c in fk.columns))]
        for u in self.unique:
            c = next(c for c in u if c != self.pk)
            found += [(f"unique {self.name} {','.join(u)}", F.col(c)) for c in (c, f"_base_{c}")]
        return found

    def judged(self, guess: DataFrame, small: bool) -> DataFrame:
        """The operations with ``ok`` as guessed, and each followed column before and after the operation."""
        guess = guess.select(F.col("at").alias("_order"), "ok", "slice", F.col("static").isNull().alias("sound"))
        ok = self.log.join(guess, F.col(self.order) == F.col("_order")).drop("_order")
        if not self.followed:
            return ok.withColumn("_again", F.lit(False))
        written = {
            f"_last_{c}": (
                "max",
                F.when(F.col("ok") & self.writes(c), F.struct(F.col(self.order).alias("at"), F.col(c).alias("value"))),
            )
            for c in self.followed
        }
        rows = running(ok, [self.pk], [self.order], written, small)
        for c in self.followed:
            last = F.col(f"_last_{c}")
            held = F.when(last.isNotNull(), last["value"]).otherwise(F.col(f"_base_{c}"))
            rows = rows.withColumn(f"_held_{c}", held).withColumn(f"_before_{c}", F.when(~self.insert, held))
            after = F.when(self.writes(c), F.col(c)).when(self.update, F.col(f"_before_{c}"))
            rows = rows.withColumn(f"_after_{c}", after)
        again = [F.coalesce(F.col(f"{last}.at") == F.col(self.order), F.lit(False)) for last in written]
        return rows.withColumn("_again", _either(again)).drop(*written)

    def tied_failures(self) -> list[tuple[Column, str]]:
        """Checks over several columns that an update of one of them breaks, and their reasons."""
        found = []
        for check in self.tied:
            # The check's own names stand for the values after the operation.
            values = ", ".join(f"'{c}', {self._after(c)}" for c in check.columns)
            asked = self.update & _either([F.col("op_column") == c for c in check.columns])
            test = _inside(check.predicate, check.columns)
            fails = F.expr(f"NOT coalesce(element_at(transform(array(named_struct({values})), _r -> {test}), 1), TRUE)")
            found.append((asked & fails, f"check {check.name}"))
        return found

    def _after(self, column: str) -> str:
        return column if column == self.pk else f"_after_{column}"

    def _tuple(self, columns: tuple[str, ...], when: str) -> Column:
        """A key of followed columns before or after the operation."""
        return _key(*[F.col(c if c == self.pk else f"_{when}_{c}") for c in columns])

    def moves(self) -> list[tuple[str, Column, Column]]:
        """What an accepted operation moves: a space of keys, the key before, and the key after."""
        own = _key(F.col(self.pk))
        found = [(f"row {self.name}", F.when(self.delete, own), F.when(self.insert, own))]
        for fk in self.spec.foreign_keys:
            found.append((f"to {fk.parent}", self._tuple(fk.columns, "before"), self._tuple(fk.columns, "after")))
        for u in self.unique:
            found.append((f"unique {self.name} {','.join(u)}", self._tuple(u, "before"), self._tuple(u, "after")))
        return found

    def questions(self) -> list[tuple[str, Column, bool, int, Column]]:
        """What an operation asks: a space, a key (null: nothing), whether it must count some or none, and the reason."""
        own = _key(F.col(self.pk))
        found = [
            (f"row {self.name}", F.when(self.insert, own), False, ROW, F.lit(f"duplicate {self.pk}")),
            (f"row {self.name}", F.when(~self.insert, own), True, ROW, F.lit("unknown key")),
        ]
        for i, fk in enumerate(self.spec.foreign_keys):
            asked = _either([self.writes(c) for c in fk.columns])
            key = F.when(asked, self._tuple(fk.columns, "after"))
            found.append((f"row {fk.parent}", key, True, PARENT + i, F.lit(f"foreign_key {fk.name}")))
        for i, u in enumerate(self.unique):
            after = self._tuple(u, "after")
            asked = _either([self.writes(c) for c in u]) & ~after.eqNullSafe(self._tuple(u, "before"))
            space = f"unique {self.name} {','.join(u)}"
            found.append((space, F.when(asked, after), False, TAKEN + i, F.lit(f"duplicate {','.join(u)}")))
        if self.parent_of:
            found.append((f"to {self.name}", F.when(self.delete, own), False, REFERENCED, F.lit("referenced")))
        # What an operation breaks by its row as it is now: a key of its own, of which there never is any.
        broken = [(F.when(bad, F.col(self.order).cast("string")), reason) for bad, reason in self.tied_failures()]
        return found + [("broken", key, True, TIED + i, F.lit(reason)) for i, (key, reason) in enumerate(broken)]

    def stream(self, rows: DataFrame) -> DataFrame:
        """Questions and moves of all operations as rows of one shape."""

        def entry(space: str, key: Column, delta: int, some: bool | None, priority: int, reason: Column) -> Column:
            return F.struct(
                F.lit(space).alias("space"), key.alias("key"), F.lit(delta).cast("long").alias("delta"),
                F.lit(some).cast("boolean").alias("some"), F.lit(priority).alias("priority"), reason.alias("reason"),
            )

        entries, none = [], F.lit(None).cast("string")
        for space, before, after in self.moves():
            moved = F.col("ok") & ~before.eqNullSafe(after)
            entries.append(entry(space, F.when(moved, before), -1, None, 0, none))
            entries.append(entry(space, F.when(moved, after), 1, None, 0, none))
        for space, key, some, priority, reason in self.questions():
            entries.append(entry(space, key, 0, some, priority, reason))
        return (
            rows.select(F.col(self.order).alias("at"), "slice", F.explode(F.array(*entries)).alias("e"))
            .select("at", "slice", "e.*")
            .where("key IS NOT NULL")
        )

    def entered(self, number: int, rows: DataFrame) -> DataFrame:
        """The judged operations as rows of one shape, with values as texts, for entering them one by one."""

        def texts(columns: list[str]) -> Column:
            return F.array(*[F.col(c).cast("string") for c in columns]).cast("array<string>")

        tied = [_failing(TIED + i, bad, reason) for i, (bad, reason) in enumerate(self.tied_failures())]
        none = F.lit(None).cast("struct<priority:int,reason:string>")
        column = reduce(lambda c, i: c.when(F.col("op_column") == self.followed[i], i), range(len(self.followed)), F.when(F.lit(False), -1))
        return rows.select(
            "slice", F.col(self.order).alias("at"), F.col("_again").alias("again"), F.lit(number).alias("number"), "op",
            column.alias("column"), "sound", F.col(self.pk).cast("string").alias("pk"), texts(self.followed).alias("new"),
            texts([f"_held_{c}" for c in self.followed]).alias("held"), F.coalesce(*tied, none).alias("tied"),
        ).select("*", "tied.*").drop("tied")

    def known(self) -> bool:
        """Whether the keys that operations ask about stand in the log, whatever becomes of earlier ones."""
        return not self.tied and all(sum(c != self.pk for c in u) == 1 for u in self.unique)

    def placed(self, number: int, sound: DataFrame, width: int) -> DataFrame:
        """The operations as rows of one shape, with values as texts: ``v0`` and so on are the followed columns."""
        column = reduce(lambda c, i: c.when(F.col("op_column") == self.followed[i], i), range(len(self.followed)), F.when(F.lit(False), -1))
        return self.log.join(sound, F.col(self.order) == F.col("_order")).select(
            "slice", F.col(self.order).cast("long").alias("at"), F.lit(number).alias("number"), "op", F.coalesce(column, F.lit(OTHER)).alias("column"),
            "sound", F.col(self.pk).cast("string").alias("pk"), *self._texts(list(self.followed), width),
        )

    def rows_held(self, number: int, width: int) -> DataFrame:
        """The followed columns of stored rows that operations name, as a state of windows."""
        held = self.log.where(_either([F.col(f"_base_{c}").isNotNull() for c in self.followed])).select(
            _key(F.col(self.pk)).alias("key"), F.struct(*self._texts([f"_base_{c}" for c in self.followed], width)).alias("v")
        )
        return held.groupBy("key").agg(F.max("v").alias("v")).select(F.lit(f"held {number}").alias("space"), "key", "v.*")

    @staticmethod
    def _texts(columns: list[str], width: int) -> list[Column]:
        cells = [F.col(c).cast("string") for c in columns] + [F.lit(None).cast("string")] * (width - len(columns))
        return [c.alias(f"v{i}") for i, c in enumerate(cells)]

    def rules(self) -> _Rules:
        place = {c: i for i, c in enumerate(self.followed)} | {self.pk: -1}
        fks = [
            (fk.parent, tuple(place[c] for c in fk.columns), PARENT + i, f"foreign_key {fk.name}")
            for i, fk in enumerate(self.spec.foreign_keys)
        ]
        uniques = [
            (f"unique {self.name} {','.join(u)}", tuple(place[c] for c in u), TAKEN + i, f"duplicate {','.join(u)}")
            for i, u in enumerate(self.unique)
        ]
        return _Rules(self.name, f"duplicate {self.pk}", fks, uniques, self.parent_of)

    def held(self, parts: list[_Table], tables: Mapping[str, DataFrame]) -> list[DataFrame]:
        """What the stored tables count for keys that operations ask about: ``space``, ``key``, ``delta``."""

        def counted(space: str, rows: DataFrame, key: Column) -> DataFrame:
            keys = rows.select(F.lit(space).alias("space"), key.alias("key")).where("key IS NOT NULL")
            return keys.groupBy("space", "key").agg(F.count(F.lit(1)).alias("delta"))

        def among(rows: DataFrame, column: str, values: list[DataFrame]) -> DataFrame:
            asked = reduce(lambda a, b: a.union(b), values).toDF("_asked").distinct()
            return rows.join(asked, rows[column] == asked["_asked"], "left_semi")

        found = []
        for u in self.unique:
            c = next(c for c in u if c != self.pk)
            values = [self.log.select(c), self.log.select(f"_base_{c}")]
            found.append(counted(f"unique {self.name} {','.join(u)}", among(self.table, c, values), _key(*map(F.col, u))))
        for parent, pk, asked in self._parents(parts, tables):
            found.append(counted(f"row {parent}", among(tables[parent], pk, asked), _key(F.col(pk))))
        return found

    def _parents(self, parts: list[_Table], tables: Mapping[str, DataFrame]) -> list[tuple[str, str, list[DataFrame]]]:
        """Tables of which operations here ask whether a row is there: its own, and parents without a log."""
        logged = {p.name for p in parts}
        own = [self.log.select(self.pk)]
        for p in parts:
            own += [p.log.select(*fk.columns) for fk in p.spec.foreign_keys if fk.parent == self.name]
        found = [(self.name, self.pk, own)]
        for fk in self.spec.foreign_keys:
            if fk.parent not in logged:
                found.append((fk.parent, fk.parent_columns[0], [self.log.select(*fk.columns)]))
        return found

    def references(self, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> list[DataFrame]:
        """How many stored rows point at each key that a delete names."""
        asked = self.log.where(self.delete).select(F.col(self.pk).alias("_asked")).distinct()
        found = []
        for child, spec in specs.items():
            for fk in spec.foreign_keys:
                if fk.parent == self.name:
                    key = F.col(fk.columns[0]).cast(self.kinds[self.pk])
                    rows = tables[child].select(key.alias("_points")).join(asked, F.col("_points") == F.col("_asked"), "left_semi")
                    counts = rows.groupBy(_key(F.col("_points")).alias("key")).agg(F.count(F.lit(1)).alias("delta"))
                    found.append(counts.select(F.lit(f"to {self.name}").alias("space"), "key", "delta"))
        return found

    def after_log(self, outcome: DataFrame) -> DataFrame:
        """The table with all accepted operations applied."""
        done = self.log.join(
            outcome.where("ok").select(F.col(self.order).alias("_order")), F.col(self.order) == F.col("_order"), "left_semi"
        )
        at = F.col(self.order)
        life = F.max(F.when(~self.update, F.struct(at.alias("at"), self.insert.alias("there")))).alias("_life")
        writes = [
            F.max(F.when(self.writes(c), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(f"_w_{c}")
            for c in self.table.columns
            if c != self.pk
        ]
        changed = done.groupBy(F.col(self.pk).alias("_key")).agg(life, *writes)
        both = self.table.withColumn("_stored", F.lit(True)).join(
            changed, F.col(self.pk) == F.col("_key"), "full_outer"
        )
        there = F.coalesce(F.col("_life.there"), F.col("_stored"), F.lit(False))
        values = [
            F.coalesce(self.pk, "_key").alias(c)
            if c == self.pk
            else F.when(F.col(f"_w_{c}").isNotNull(), F.col(f"_w_{c}.value")).otherwise(F.col(c)).alias(c)
            for c in self.table.columns
        ]
        return both.where(there).select(*values)


def _inside(predicate: str, columns: tuple[str, ...]) -> str:
    """A predicate whose columns are the fields of ``_r``."""
    names = "|".join(sorted(map(re.escape, columns), key=len, reverse=True))
    return re.sub(rf"(?<![\w.'])({names})(?![\w'])", r"_r.\1", predicate)


def doubled(judged: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``at``, ``implied`` of every operation that hangs on another: the ``ok`` at the end of its chain, turned over as
    often as the chain says."""
    chain = store(judged.where("hangs_on IS NOT NULL").select("at", "hangs_on", "flip"))
    moving = True
    while moving:
        further = chain.select(F.col("at").alias("_at"), F.col("hangs_on").alias("_on"), F.col("flip").alias("_flip"))
        met = chain.join(further, F.col("hangs_on") == F.col("_at"), "left")
        chain = store(
            met.select(
                "at",
                F.coalesce("_on", "hangs_on").alias("hangs_on"),
                (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"),
                F.col("_at").isNotNull().alias("moved"),
            )
        )
        moving = not chain.where("moved").isEmpty()
    ends = judged.where("hangs_on IS NULL").select(F.col("at").alias("_at"), "ok")
    return chain.join(ends, F.col("hangs_on") == F.col("_at")).select("at", (F.col("ok") != F.col("flip")).alias("implied"))


def _key_of(values: list[str | None], pk: str | None, places: tuple[int, ...]) -> str | None:
    """As ``_key``."""
    text = ""
    for i in places:
        value = pk if i < 0 else values[i]
        if value is None:
            return None
        text += f"{len(value)}:{value}"
    return text


class _Entry(NamedTuple):
    """What one operation breaks by what is there before it, and what it changes if it breaks nothing."""

    broken: tuple[int, str] | None
    row: tuple[int, str | None]
    values: list[str | None]
    moves: list[tuple[str, str | None, str | None]]


class _State:
    """Counts by space and key, and followed columns by table and primary key, as they are while operations are entered."""

    def __init__(self, rules: list[_Rules]):
        self.rules = rules
        self.counts: dict[str, dict[str, int]] = defaultdict(dict)
        self.held: dict[tuple[int, str | None], list[str | None]] = {}
        self.written: set[tuple[int, str | None]] = set()

    def judged(self, number: int, op: str | None, column: int, pk: str | None, new: list, was: list, broken: tuple[int, str] | None) -> _Entry:
        """An operation; ``was`` holds the columns of its row where no operation has named the row before."""
        rule, counts = self.rules[number], self.counts
        own = None if pk is None else f"{len(pk)}:{pk}"
        held = self.held.setdefault((number, own), was)
        insert = op == "insert"
        if insert:
            before, after = [None] * len(new), new
        elif op == "update":
            before, after = held, held.copy()
            if column >= 0:
                after[column] = new[column]
        else:
            before, after = held, [None] * len(new)
        found = [] if broken is None else [broken]
        there = counts[f"row {rule.name}"].get(own, 0) > 0
        if own is not None and op is not None and there == insert:
            found.append((ROW, rule.duplicate if there else "unknown key"))
        moves = [(f"row {rule.name}", own if op == "delete" else None, own if insert else None)]
        for parent, places, priority, reason in rule.fks:
            old, key = _key_of(before, pk, places), _key_of(after, pk, places)
            if key is not None and (insert or (op == "update" and column in places)) and counts[f"row {parent}"].get(key, 0) <= 0:
                found.append((priority, reason))
            moves.append((f"to {parent}", old, key))
        for space, places, priority, reason in rule.uniques:
            old, key = _key_of(before, pk, places), _key_of(after, pk, places)
            if key is not None and key != old and (insert or (op == "update" and column in places)) and counts[space].get(key, 0) > 0:
                found.append((priority, reason))
            moves.append((space, old, key))
        if rule.parent_of and op == "delete" and counts[f"to {rule.name}"].get(own, 0) > 0:
            found.append((REFERENCED, "referenced"))
        return _Entry(min(found, default=None), (number, own), held if op == "delete" else after, moves)

    def enter(self, entry: _Entry) -> None:
        for space, old, key in entry.moves:
            if old != key:
                counts = self.counts[space]
                if old is not None:
                    counts[old] = counts.get(old, 0) - 1
                if key is not None:
                    counts[key] = counts.get(key, 0) + 1
        self.held[entry.row] = entry.values
        self.written.add(entry.row)

    def entered(self, rows: Iterable[tuple]) -> pa.Table:
        """Of operations in order, given as ``at``, ``sound`` and what ``judged`` takes, the first rule that each refused one breaks."""
        unmet = []
        # Operations of one order number do not see one another.
        for at, same in groupby(rows, key=itemgetter(0)):
            same = [(sound, asked, self.judged(*asked)) for _, sound, *asked in same]
            found = min((entry.broken for *_, entry in same if entry.broken is not None), default=None)
            if found is not None:
                unmet.append((at, *found))
                continue
            first = True
            for sound, asked, entry in same:
                if sound:
                    self.enter(entry if first else self.judged(*asked))
                    first = False
        ats, priorities, reasons = zip(*unmet, strict=True) if unmet else ([], [], [])
        return pa.table(
            {"at": pa.array(ats, pa.int64()), "priority": pa.array(priorities, pa.int32()), "reason": pa.array(reasons, pa.string())}
        )


def _entered(rules: list[_Rules], ops: pa.Table, starts: pa.Table) -> pa.Table:
    """The operations of one slice entered one by one: the first rule that each one breaks by what was there before it."""
    state = _State(rules)
    for space, key, count in zip(*(starts[c].to_pylist() for c in ("space", "key", "count")), strict=True):
        state.counts[space][key] = count
    columns = ["at", "again", "sound", "number", "op", "column", "pk", "new", "held", "priority", "reason"]
    rows = sorted(zip(*(ops[c].to_pylist() for c in columns), strict=True), key=itemgetter(0, 1))
    return state.entered(
        (at, sound, number, op, OTHER if column is None else column, pk, new, held, None if priority is None else (priority, reason))
        for at, _, sound, number, op, column, pk, new, held, priority, reason in rows
    )


def _texts_of(column: pa.ChunkedArray) -> list[str | None]:
    return column.combine_chunks().to_numpy(zero_copy_only=False).tolist()


def _window_entered(rules: list[_Rules], width: int, ops: pa.Table, starts: pa.Table) -> pa.Table:
    """The operations of one window entered one by one: the first rule that each refused one breaks, and what the window changes."""
    state, values = _State(rules), [f"v{i}" for i in range(width)]
    numbers = {f"held {i}": i for i in range(len(rules))}
    for space in pc.unique(starts["space"]).to_pylist():
        some = starts.filter(pc.equal(starts["space"], space))
        if space in numbers:
            cells = zip(*(_texts_of(some[v]) for v in values), strict=True)
            state.held |= {(numbers[space], key): list(row) for key, row in zip(_texts_of(some["key"]), cells, strict=True)}
        else:
            state.counts[space] = dict(zip(_texts_of(some["key"]), some["delta"].to_numpy().tolist(), strict=True))
    before = {space: counts.copy() for space, counts in state.counts.items()}
    ops = ops.take(pc.sort_indices(ops, [("at", "ascending")]))
    rows = zip(
        ops["at"].to_numpy().tolist(), ops["sound"].to_numpy().tolist(), ops["number"].to_numpy().tolist(), _texts_of(ops["op"]),
        ops["column"].to_numpy().tolist(), _texts_of(ops["pk"]), *(_texts_of(ops[v]) for v in values), strict=True,
    )
    unmet = state.entered((at, sound, n, op, column, pk, new, [None] * width, None) for at, sound, n, op, column, pk, *new in rows)
    spaces, keys, deltas = [], [], []
    for space, counts in state.counts.items():
        was = before.pop(space, {})
        for key, count in counts.items():
            if count != was.get(key, 0):
                spaces.append(space)
                keys.append(key)
                deltas.append(count - was.get(key, 0))
    moved = pa.table({"space": pa.array(spaces, pa.string()), "key": pa.array(keys, pa.string()), "delta": pa.array(deltas, pa.int64())})
    rows = [row for row in state.written if row[1] is not None and width]
    held = pa.table(
        {"space": pa.array([f"held {n}" for n, _ in rows], pa.string()), "key": pa.array([key for _, key in rows], pa.string())}
        | {v: pa.array([state.held[row][i] for row in rows], pa.string()) for i, v in enumerate(values)}
    )
    changed = pa.concat_tables([moved, held], promote_options="default").select(["space", "key", "delta", *values])
    return pa.concat_tables([unmet, changed], promote_options="default").select([*unmet.column_names, *changed.column_names])


def _asked(rules: list[_Rules]) -> Column:
    """Spaces and keys whose counts and values operations of windows ask about."""
    insert, update, delete = (F.col("op") == op for op in OPS)
    own, none = _key(F.col("pk")), F.lit(None).cast("string")
    each = none
    for number, rule in enumerate(rules):
        found = [*((f"row {fk[0]}", fk[1]) for fk in rule.fks), *(u[:2] for u in rule.uniques)]
        spaces = [(f"row {rule.name}", own)] + ([(f"held {number}", own)] if found else [])
        for space, places in found:
            key = _key(*[F.col("pk" if i < 0 else f"v{i}") for i in places])
            spaces.append((space, F.when(insert | (update & F.col("column").isin(*places)), key)))
        if rule.parent_of:
            spaces.append((f"to {rule.name}", F.when(delete, own)))
        keys = F.array(*[F.struct(F.lit(space).alias("space"), key.alias("key")) for space, key in spaces])
        each = F.when(F.col("number") == number, keys) if number == 0 else each.when(F.col("number") == number, keys)
    return F.explode(each)


def _in_windows(parts: list[_Table], found: DataFrame, stored: DataFrame, windows: int) -> DataFrame:
    """The outcome: each operation with ``ok`` and ``reason``.  What operations ask about must be known from the log."""
    spark, rules, width = found.sparkSession, [p.rules() for p in parts], max(len(p.followed) for p in parts)
    sound = found.select(F.col("at").alias("_order"), "slice", F.col("static").isNull().alias("sound"))
    values = [f"v{i}" for i in range(width)]
    texts = "".join(f", {v} string" for v in values)
    # Of a key, counts of all runs are added up, and values are those of the last.
    state = f"space string, key string, delta long{texts}, run int"
    with scratch_folder(spark, "log") as folder:
        ops = union_all(p.placed(i, sound, width) for i, p in enumerate(parts))
        dealt = ops.repartition(FILES * windows, "slice", F.pmod(F.hash("at"), F.lit(FILES)))
        dealt.write.partitionBy("slice").parquet(f"{folder}/ops")
        ops = spark.read.schema(ops.schema).parquet(f"{folder}/ops")

        def entered(of: Iterable[int]) -> DataFrame:
            paths = [f"{folder}/entered/run={i}" for i in of]
            kinds = f"at long, priority int, reason string, {state}"
            return spark.read.schema(kinds).option("basePath", f"{folder}/entered").parquet(*paths)

        def folded(rows: DataFrame) -> DataFrame:
            last = F.max(F.struct("run", *values)).alias("last")
            return rows.groupBy("space", "key").agg(F.sum("delta").alias("delta"), last).select(
                "space", "key", "delta", *[f"last.{v}" for v in values], "last.run"
            ).where("delta IS NULL OR delta <> 0")

        held = [p.rows_held(i, width) for i, p in enumerate(parts) if p.followed]
        base = union_all([stored.select("space", "key", F.col("delta").cast("long").alias("delta"), *[F.lit(None).cast("string").alias(v) for v in values]),
                          *[h.select("space", "key", F.lit(None).cast("long").alias("delta"), *values) for h in held]])
        base.withColumn("run", F.lit(-1)).write.parquet(f"{folder}/state/0")
        since = 0
        kept = spark.read.schema(state).parquet(f"{folder}/state/0")
        for run in range(windows):
            so_far = kept
            if run > since:
                so_far = kept.unionByName(entered(range(since, run)).where("space IS NOT NULL").select(kept.columns))
            if run - since == RUNS:
                folded(so_far).write.parquet(f"{folder}/state/{run}")
                since = run
                so_far = kept = spark.read.schema(state).parquet(f"{folder}/state/{run}")
            mine = ops.where(F.col("slice") == run)
            asked = mine.select(_asked(rules).alias("a")).select("a.*").where("key IS NOT NULL").distinct()
            # Not broadcast: as files, operations are far smaller than the keys that they name.
            starts = folded(so_far.join(asked.hint("merge"), ["space", "key"], "left_semi")).withColumn("_of", F.lit(run))
            done = mine.groupBy("slice").cogroup(starts.groupBy("_of")).applyInArrow(
                lambda ops, starts: _window_entered(rules, width, ops, starts),
                f"at long, priority int, reason string, space string, key string, delta long{texts}",
            )
            done.write.parquet(f"{folder}/entered/run={run}")
        answers = entered(range(windows)).where("at IS NOT NULL").select("at", F.struct("priority", "reason").alias("unmet"))
        # As files they are far smaller than as rows.
        return durable(_answered(found, answers.hint("merge")))


def _answered(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Each operation with ``ok`` and ``reason``, and what it ``was`` taken for."""
    rows = found.select("at", "slice", "table_name", "op", "static", F.col("ok").alias("was")).join(answers, "at", "left")
    rows = rows.withColumn("first", F.array_min(F.array_compact(F.array("static", "unmet"))))
    return rows.select(
        "at", "slice", "table_name", "op", "static", "was", F.col("first.reason").alias("reason"), F.col("first").isNull().alias("ok")
    )


def _replayed(parts: list[_Table], found: DataFrame, stored: DataFrame, small: bool, slices: int) -> DataFrame:
    """``at``, ``unmet`` of each operation that its slice refuses, when slices start from what the guess gives."""
    judged = [p.judged(found, small) for p in parts]
    events = union_all(p.stream(rows) for p, rows in zip(parts, judged, strict=True))
    moved = events.groupBy("space", "key", "slice").agg(
        F.sum("delta").alias("delta"), F.max(F.col("some").isNotNull()).alias("asked")
    )
    held = stored.select("space", "key", F.lit(-1).alias("slice"), F.col("delta").cast("long").alias("delta"), F.lit(False).alias("asked"))
    # A key has as many rows as there are slices, and those of the stored tables.
    before = Window.partitionBy("space", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = moved.unionByName(held).withColumn("count", F.sum("delta").over(before)).where("asked AND count IS NOT NULL")
    starts = starts.select(F.col("slice").alias("_of"), "space", "key", "count").repartition(slices, "_of")
    ops = union_all(p.entered(i, rows) for i, (p, rows) in enumerate(zip(parts, judged, strict=True)))
    rules = [p.rules() for p in parts]
    done = ops.repartition(slices, "slice").groupBy("slice").cogroup(starts.groupBy("_of")).applyInArrow(
        lambda ops, starts: _entered(rules, ops, starts), "at long, priority int, reason string"
    )
    return done.select("at", F.struct("priority", "reason").alias("unmet"))


def _settled(
    parts: list[_Table], found: DataFrame, stored: DataFrame, small: bool, slices: int, store: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The guess that stays as it is: each operation with ``ok`` and ``reason``."""
    rounds = 0
    while True:
        found = store(_answered(found, _replayed(parts, found, stored, small, slices)))
        if found.where("ok <> was").isEmpty():
            return found
        rounds += 1
        if rounds % PATIENCE == 0:
            found = _along_chains(parts, found, stored, small, store)


def _along_chains(
    parts: list[_Table], found: DataFrame, stored: DataFrame, small: bool, store: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The next guess, with chains of operations that hang on one another followed to their ends."""
    events = union_all(p.stream(p.judged(found, small)) for p in parts).unionByName(stored, allowMissingColumns=True)
    effect = F.when((F.col("delta") != 0) & F.col("at").isNotNull(), F.struct("at", "delta"))
    counts = running(
        events, ["space", "key"], ["at", F.col("some").isNull()],
        {"count": ("sum", F.col("delta")), "last": ("max", effect)}, small,
    )
    answered = counts.where("some IS NOT NULL").select(
        "at", "priority", "reason", (F.col("some") == (F.col("count") > 0)).alias("met"),
        F.col("last.at").alias("on"), (F.col("some") == (F.col("last.delta") > 0)).alias("implied"),
    )
    hangs = F.col("met") == F.col("implied")  # null where nothing happened before
    answers = answered.groupBy("at").agg(
        F.min(F.when(~F.col("met"), F.struct("priority", "reason"))).alias("unmet"),
        F.count_if(hangs).alias("open"),
        F.count_if(~F.col("met") & ~F.coalesce(hangs, F.lit(False))).alias("settled"),
        F.max(F.when(hangs, F.struct("on", (~F.col("implied")).alias("flip")))).alias("link"),
    )
    rows = found.select("at", "slice", "table_name", "op", "static").join(answers, "at", "left")
    rows = rows.withColumn("first", F.array_min(F.array_compact(F.array("static", "unmet"))))
    link = F.when(F.col("static").isNull() & (F.col("open") == 1) & (F.col("settled") == 0), F.col("link"))
    judged = store(
        rows.select(
            "at", "slice", "table_name", "op", "static", F.col("first.reason").alias("reason"),
            F.col("first").isNull().alias("ok"), link["on"].alias("hangs_on"), link["flip"].alias("flip"),
        )
    )
    met = judged.join(doubled(judged, store), "at", "left")
    return store(met.withColumn("ok", F.coalesce("implied", "ok")).drop("implied", "hangs_on", "flip"))


def apply_log(
    tables: Mapping[str, DataFrame],
    logs: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    order: str,
) -> Logged:
    """The tables after all operations, and what became of each, as if they had been entered one by one in ``order``.

    Each log has the columns of its table, ``order`` (unique over all logs), ``op`` (insert, update or delete) and ``op_column``.
    An insert brings a whole row; an update sets the column ``op_column`` of the row with its primary key to the value it
    has there, null included; a delete names the primary key.  Keys are single columns; foreign keys lead to primary
    keys of other tables; a primary key is not updated.  ``tables`` and ``specs`` hold every table that points at one with a log.

    ``outcomes`` has ``order``, ``table_name``, ``op``, ``outcome`` (accepted, unknown key or rejected) and the first ``reason``.
    An update or delete of a row that is not there at that moment is of an unknown key, unless its value breaks a rule.

    A key may have any number of operations.  Where the rules are over single columns, windows of about ``WINDOW`` operations are entered
    one after the other, each in one task.  Otherwise outcomes are guessed in rounds: a task enters the operations of one slice, about ``SLICE``
    of them, and sums over more events of a key than a task should sort are spread over tasks.  There are at most about as many rounds
    as slices, fewer where slices hardly depend on earlier ones; along chains the length only counts by its logarithm.
    """
    parts = [_Table(name, tables[name], log, specs, order) for name, log in logs.items()]
    found = union_all(
        p.log.select(F.col(order).alias("at"), F.lit(p.name).alias("table_name"), "op", "static", F.col("static").isNull().alias("ok"))
        for p in parts
    )
    # Ranges of about as many operations each; equal order numbers stay together.
    known = all(p.known() for p in parts)
    slices = -(-max(found.count(), 1) // (WINDOW if known else SLICE))
    found = durable(found.repartitionByRange(slices, "at").withColumn("slice", F.spark_partition_id()))
    # Stored rows count from the start.
    held = [f for p in parts for f in [*p.held(parts, tables), *p.references(tables, specs)]]
    stored = durable(union_all(held).select(F.lit(None).cast("long").alias("at"), "*"))
    if known:
        found = _in_windows(parts, found, stored, slices)
    else:
        # An operation has up to two events at a key that it names, and one at a key that it leaves.
        named = union_all(p.log.select(F.lit(s).alias("space"), _key(c).alias("key")) for p in parts for s, c in p.mentions())
        most = named.groupBy("space", "key").count().where("key IS NOT NULL").agg(F.max("count")).first()[0] or 0
        with in_rounds(found.sparkSession) as store:
            found = durable(_settled(parts, found, stored, 3 * most <= SMALL, slices, store))
    outcome = F.when(F.col("ok"), "accepted").when(F.col("reason") == "unknown key", "unknown key").otherwise("rejected")
    reason = F.when(F.col("reason") != "unknown key", F.col("reason"))
    outcomes = found.select(
        F.col("at").alias(order), "table_name", "op", outcome.alias("outcome"), reason.alias("reason")
    )
    done = found.select(F.col("at").alias(order), "ok")
    after = dict(tables) | {p.name: p.after_log(done) for p in parts}
    return Logged(after, outcomes)
