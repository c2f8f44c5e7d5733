"""An ordered log over several tables against entering its operations one by one."""

import random

import pytest

from stayspark.model import Check, ForeignKey, TableSpec
from stayspark.operators import change_log
from stayspark.operators.change_log import apply_log

HOME = TableSpec("home", ("h",), not_null=("name",))
KID = TableSpec(
    "kid", ("k",), not_null=("a",),
    checks=(Check("small", "a < 90", ("a",)), Check("pair", "a <= b", ("a", "b"))),
    unique=(("seat",), ("a", "b")),
    foreign_keys=(ForeignKey(("p",), "home", ("h",)),),
)
SPECS = {"home": HOME, "kid": KID}
COLUMNS = {"home": ["h", "name"], "kid": ["k", "p", "a", "b", "seat"]}
SCHEMAS = {"home": "h long, name string", "kid": "k long, p long, a int, b int, seat string"}


def replay(tables, log):
    """Operations one by one; rows are dicts by key."""
    homes = {r[0]: dict(zip(COLUMNS["home"], r, strict=True)) for r in tables["home"]}
    kids = {r[0]: dict(zip(COLUMNS["kid"], r, strict=True)) for r in tables["kid"]}
    held = {"home": homes, "kid": kids}
    out = {}
    for at, name, op, column, values in sorted(log, key=lambda x: x[0]):
        spec, rows = SPECS[name], held[name]
        given = dict(zip(COLUMNS[name], values, strict=True))
        pk = spec.primary_key[0]
        writes = list(given) if op == "insert" else [column] if op == "update" else []

        def reason():
            if given[pk] is None:
                return f"not_null {pk}"
            for c in spec.required:
                if c in writes and given[c] is None:
                    return f"not_null {c}"
            if name == "kid":
                if "a" in writes and given["a"] >= 90:
                    return "check small"
                if op == "insert" and None not in (given["a"], given["b"]) and not given["a"] <= given["b"]:
                    return "check pair"
                if "p" in writes and given["p"] is not None and given["p"] not in homes:
                    return "foreign_key p->home"
            there = given[pk] in rows
            if op == "insert" and there:
                return f"duplicate {pk}"
            if op != "insert" and not there:
                return "unknown key"
            if name == "kid" and op != "delete":
                new = given if op == "insert" else {**rows[given[pk]], column: given[column]}
                if op == "update" and column in "ab" and None not in (new["a"], new["b"]) and not new["a"] <= new["b"]:
                    return "check pair"
                others = [r for k, r in kids.items() if k != given[pk]]
                if "seat" in writes and new["seat"] is not None and any(r["seat"] == new["seat"] for r in others):
                    return "duplicate seat"
                pair = (new["a"], new["b"])
                if {"a", "b"} & set(writes) and None not in pair and any((r["a"], r["b"]) == pair for r in others):
                    return "duplicate a,b"
            if name == "home" and op == "delete" and any(r["p"] == given[pk] for r in kids.values()):
                return "referenced"
            return None

        bad = reason()
        out[at] = ("accepted", None) if bad is None else ("unknown key", None) if bad == "unknown key" else ("rejected", bad)
        if bad is None:
            if op == "insert":
                rows[given[pk]] = given
            elif op == "update":
                rows[given[pk]][column] = given[column]
            else:
                del rows[given[pk]]
    return {n: sorted((tuple(r.values()) for r in rows.values()), key=str) for n, rows in held.items()}, out


def check(spark, tables, log):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]).repartition(3) for n, rows in tables.items()}
    logs = {
        n: spark.createDataFrame(
            [(at, op, column, *values) for at, t, op, column, values in log if t == n],
            f"at long, op string, op_column string, {SCHEMAS[n]}",
        ).repartition(4)
        for n in SPECS
    }
    done = apply_log(frames, logs, SPECS, "at")
    want, outcomes = replay(tables, log)
    assert {r["at"]: (r.outcome, r.reason) for r in done.outcomes.collect()} == outcomes
    for n, rows in want.items():
        assert done.tables[n].columns == COLUMNS[n]
        assert sorted(map(tuple, done.tables[n].collect()), key=str) == rows
    return outcomes


def kid(k, p=None, a=1, b=None, seat=None):
    return (k, p, a, b, seat)


def put(at, k, column, value):
    cells = {"k": k, "p": None, "a": None, "b": None, "seat": None, column: value}
    return (at, "kid", "update", column, tuple(cells.values()))


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    keys = range(5 if seed % 2 else 9)
    some = lambda values: rng.choice([None, *values]) if rng.random() < 0.95 else None
    row = lambda: (some(keys), some(keys), some([*range(4), 95]), some(range(5)), some("vwxyz"))
    homes = [(h, "n") for h in keys if h % 2]
    kids, seats, pairs = [], set(), set()
    for k in range(0, 9, 2):
        a, b, seat = rng.randrange(2), rng.randrange(2, 5), rng.choice("vwxyz")
        if seat not in seats and (a, b) not in pairs:
            kids.append((k, rng.choice([h for h, _ in homes]), a, b, seat))
            seats.add(seat)
            pairs.add((a, b))
    log = []
    for at in range(160):
        table = rng.choice(["home", "kid", "kid"])
        op = rng.choice(["insert", "insert", "update", "update", "delete"])
        values = (some(keys), some(["x"])) if table == "home" else row()
        column = (rng.choice(["name"]) if table == "home" else rng.choice("pab") if rng.random() < 0.5 else "seat")
        log.append((at * 3, table, op, column if op == "update" else None, values))
    outcomes = check(spark, {"home": homes, "kid": kids}, log)
    assert len({o for o, _ in outcomes.values()}) == 3


def test_values_are_handed_over(spark, monkeypatch):
    """Chains, a cycle that needs a free seat, and refusals that run down a chain."""
    n = 200
    kids = [kid(k, a=0, seat=f"s{k}") for k in range(n)]
    # The first frees its seat, each next one takes what was freed.
    log = [put(0, 0, "seat", "new")] + [put(k, k, "seat", f"s{k - 1}") for k in range(1, n)]
    assert set(check(spark, {"home": [], "kid": kids}, log).values()) == {("accepted", None)}
    rounds = []
    plain = change_log._Table.stream
    monkeypatch.setattr(change_log._Table, "stream", lambda self, rows: rounds.append(self.name) or plain(self, rows))
    # The first is refused, so all are: no round per link.
    log = [put(0, 0, "seat", f"s{n - 1}")] + [put(k, k, "seat", f"s{k - 1}") for k in range(1, n)]
    assert set(check(spark, {"home": [], "kid": kids}, log).values()) == {("rejected", "duplicate seat")}
    assert len(rounds) <= 2 * (change_log.PATIENCE + 2)
    # A cycle by way of a seat that nobody holds.
    three = [kid(k, a=0, seat=f"s{k}") for k in range(3)]
    log = [put(1, 0, "seat", "free"), put(2, 1, "seat", "s0"), put(3, 2, "seat", "s1"), put(4, 0, "seat", "s2"), put(5, 1, "seat", "s2")]
    outcomes = check(spark, {"home": [], "kid": three}, log)
    assert [outcomes[i][0] for i in range(1, 6)] == ["accepted"] * 4 + ["rejected"]


def test_lives_of_parents(spark):
    """A child written before, during and after the lives of its parent; deletes that wait for the last child."""
    log = [
        (1, "kid", "insert", None, kid(1, p=7)), (2, "home", "insert", None, (7, "x")), (3, "kid", "insert", None, kid(1, p=7)),
        (4, "home", "delete", None, (7, None)), (5, "kid", "delete", None, kid(1)), (6, "home", "delete", None, (7, None)),
        (7, "kid", "insert", None, kid(1, p=7)), (8, "home", "insert", None, (7, "y")), (9, "kid", "insert", None, kid(2, p=7)),
        put(10, 2, "p", None), (11, "home", "delete", None, (7, None)), (12, "home", "update", "name", (7, "z")),
    ]
    outcomes = check(spark, {"home": [], "kid": []}, log)
    assert [outcomes[i][0] for i in (1, 3, 4, 6, 7, 11, 12)] == [
        "rejected", "accepted", "rejected", "accepted", "rejected", "accepted", "unknown key",
    ]


def test_no_operations(spark):
    assert check(spark, {"home": [(1, "x")], "kid": [kid(1, p=1)]}, []) == {}


def test_logs_that_do_not_fit_are_refused(spark):
    home = spark.createDataFrame([], SCHEMAS["home"])
    log = spark.createDataFrame([], "at long, op string, h long, name string")
    with pytest.raises(ValueError):
        apply_log({"home": home}, {"home": log}, {"home": HOME}, "at")


def test_dense_logs_in_slices(spark, monkeypatch):
    """Decisions that hang on several others, far along the log: at most a round per slice, besides those for chains."""
    rng = random.Random(11)
    keys = range(4)
    log = []
    for at in range(300):
        op = rng.choice(["insert", "update", "update", "delete"])
        if rng.random() < 0.3:
            log.append((at, "home", op, "name" if op == "update" else None, (rng.choice(keys), "x")))
        else:
            column = rng.choice(["p", "seat"]) if op == "update" else None
            log.append((at, "kid", op, column, kid(rng.choice(keys), rng.choice(keys), 1, None, rng.choice("xyzv"))))
    rounds = []
    plain = change_log._Table.stream
    monkeypatch.setattr(change_log._Table, "stream", lambda self, rows: rounds.append(self.name) or plain(self, rows))
    monkeypatch.setattr(change_log, "SLICE", 100)
    tables = {"home": [(0, "n"), (2, "n")], "kid": [kid(0, 0, seat="x"), kid(1, 2, seat="y")]}
    check(spark, tables, log)
    assert len(rounds) <= 2 * (3 + 1 + 1)


def test_logs_over_single_columns_enter_each_operation_once(spark, monkeypatch):
    """Dense decisions over many windows, with states folded in between: no rounds of guesses."""
    plain = TableSpec("kid", ("k",), not_null=("a",), checks=KID.checks[:1], unique=(("seat",),), foreign_keys=KID.foreign_keys)
    monkeypatch.setitem(SPECS, "kid", plain)
    rng = random.Random(5)
    keys = range(6)
    some = lambda values: rng.choice(list(values)) if rng.random() < 0.95 else None
    log = []
    for at in range(360):
        op = rng.choice(["insert", "update", "update", "delete"]) if at % 50 else "replace"
        if rng.random() < 0.3:
            log.append((at * 2, "home", op, "name" if op == "update" else None, (some(keys), some("x"))))
        else:
            column = rng.choice(["p", "seat", "a"]) if op == "update" else None
            log.append((at * 2, "kid", op, column, kid(some(keys), some(keys), rng.choice([1, 2, 95]), None, some("vwxyz"))))
    rounds = []
    stream = change_log._Table.stream
    monkeypatch.setattr(change_log._Table, "stream", lambda self, rows: rounds.append(self.name) or stream(self, rows))
    monkeypatch.setattr(change_log, "SLICE", 60)
    monkeypatch.setattr(change_log, "WINDOW", 60, raising=False)
    monkeypatch.setattr(change_log, "RUNS", 2, raising=False)
    tables = {"home": [(0, "n"), (2, "n"), (4, "n")], "kid": [kid(0, 0, seat="x"), kid(1, 2, seat="y"), kid(5, None, seat=None)]}
    # The replay knows of no operation but these three; the others are refused by themselves.
    known = [x for x in log if x[2] != "replace"]
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in tables.items()}
    logs = {
        n: spark.createDataFrame([(at, op, c, *v) for at, t, op, c, v in log if t == n], f"at long, op string, op_column string, {SCHEMAS[n]}")
        for n in SPECS
    }
    done = apply_log(frames, logs, SPECS, "at")
    want, outcomes = replay(tables, known)
    got = {r["at"]: (r.outcome, r.reason) for r in done.outcomes.collect()}
    assert {at: got[at] for at in outcomes} == outcomes
    assert {o for at, (o, _) in got.items() if at not in outcomes} == {"rejected"}
    assert {"foreign_key p->home", "duplicate k", "duplicate h", "duplicate seat", "referenced"} <= {r for _, r in outcomes.values()}
    for n, rows in want.items():
        assert sorted(map(tuple, done.tables[n].collect()), key=str) == rows
    assert not rounds
