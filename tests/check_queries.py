"""Compares registered queries with their SQL: python -m tests.check_queries [sf] [name part ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

import __spark_entry__ as entry
from footprints.session import local_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET memory_limit = '8GB'")
    con.execute("SET max_temp_directory_size = '4GB'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None:
        return None
    if hasattr(value, "is_integer") and isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() and abs(value) < 1e15 else value
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "as_tuple"):
        return normal(float(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(normal(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in r),
    )


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return "rows-only", len(got), t1 - t0, 0.0, ""
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    t2 = time.time()
    types = dict(df.dtypes)
    note = ""
    if sorted(df.columns) != sorted(columns):
        return "COLUMNS", len(got), t1 - t0, t2 - t1, f"{sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return "COUNT", len(got), t1 - t0, t2 - t1, f"{len(got)} vs {len(want)}; {got[:2]} {want[:2]}"
    exact = got == want
    if not exact:
        for g, w in zip(got, want):
            if g != w:
                return "VALUES", len(got), t1 - t0, t2 - t1, f"{sorted(columns)} {g} vs {w}"
    return ("ok" if got else "EMPTY"), len(got), t1 - t0, t2 - t1, note


def main(argv):
    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, n, a, b, note = compare(spark, con, folder, name, fn, oracle.get(name))
        except Exception as e:  # report and go on with the next query
            status, n, a, b, note = "ERROR", 0, 0.0, 0.0, str(e)[:1500]
        if status not in ("ok", "rows-only"):
            bad += 1
        print(f"{status:10} {name:44} rows={n:<8} spark={a:6.2f}s sql={b:6.2f}s {note[:1500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
