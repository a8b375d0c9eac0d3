"""Run registered queries beside their SQL on DuckDB and compare them value by value.

    python tests/oracle.py [sf] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark, con, sf, query, sql):
    """(problem or None, rows, seconds for Spark)."""
    start = time.time()
    df = query(spark, sf)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return None if got else "no rows", len(got), seconds
    result = con.execute(sql)
    names, rows = _rows(df.columns, [tuple(r) for r in got])
    want_names, want = _rows([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} against {want_names}", len(rows), seconds
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}", len(rows), seconds
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    types = {
        (n, type(a).__name__, type(b).__name__)
        for r, w in zip(rows, want)
        for n, a, b in zip(names, r, w)
        if a is not None and b is not None and type(a) is not type(b)
    }
    if types:
        return f"types differ: {sorted(types)[:3]}", len(rows), seconds
    if bad:
        return f"{len(bad)} rows differ, first {bad[:2]}", len(rows), seconds
    return None, len(rows), seconds


def main() -> int:
    from labelpool.queries import all_queries
    from labelpool.session import local_session

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, (query, sql) in all_queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            problem, rows, seconds = compare(spark, con, sf, query, sql)
        except Exception as e:  # report and go on
            problem, rows, seconds = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        failed += problem is not None
        mark = "rows" if sql is None else "ok"
        print(f"{name:28s} {rows:8d} {seconds:7.2f}  {problem or mark}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
