"""Compare registered queries with DuckDB on the same files.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb


def duck(folder: str):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def duck_rows(db, sql: str):
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def _cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(r[i]).__name__, str(r[i])) for i in order) for r in rows)


def difference(db, sql: str, df) -> str | None:
    """None when columns, value types and values agree, else what differs."""
    names, expected = duck_rows(db, sql)
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want, have = _cells(names, expected), _cells(df.columns, got)
    if want != have:
        missing, extra = list((want - have).items())[:2], list((have - want).items())[:2]
        return f"{len(got)} rows, expected {len(expected)}\n  missing {missing}\n  extra {extra}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from stayspark.registry import ORACLES, QUERIES
    from stayspark.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, db = local_session(), duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = difference(db, ORACLES[name], df)
                rows = len(duck_rows(db, ORACLES[name])[1])
            else:
                problem, rows = None, df.count()
        except Exception as exc:  # noqa: BLE001
            problem, rows = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += problem is not None
        state = "ok" if problem is None else f"FAIL {problem}"
        checked = "" if name in ORACLES else " (rows only)"
        print(f"{name:30s} {time.time() - start:6.2f}s {rows:7d} {state}{checked}", flush=True)
    print("failures:", bad)
    spark.stop()
