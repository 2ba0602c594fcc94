"""Run a query in Spark and its check in DuckDB and compare: columns, row count, values.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veritrail.plans.fixtures import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return repr(value)
    return repr(value) if not isinstance(value, str) else value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, folder: str, build, sql: str | None):
    """``None`` when both sides agree, else a short description of the first difference."""
    frame = build(spark, folder)
    left = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None, len(left)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    right = rows(names, found.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(left)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        cells = [(n, str(x)[:160], str(y)[:160]) for n, x, y in zip(sorted(names), *bad[0]) if x != y]
        return f"{len(bad)} rows differ, first: {cells[:3]} in {str(bad[0][0])[:200]}", len(left)
    return None, len(left)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from veritrail.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    checks, failed = oracle_sql(), 0
    for name, build in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, folder, build, checks.get(name))
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        failed += problem is not None
        state = "ok  " if problem is None else "FAIL"
        print(f"{state} {name:24s} rows={n:<8d} {time.time() - start:6.2f}s {'' if name in checks else '(no sql) '}{problem or ''}", flush=True)
    print("failed:", failed)
