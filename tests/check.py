"""Compare registered queries with their DuckDB twins: ``python tests/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from registry.roles import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (decimal.Decimal, float)):
        value = float(value)
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def shape(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str | None, folder: str):
    """(ok, message, rows, seconds)."""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, "no SQL", len(got), took
    cur = con.execute(sql)
    want_names, want = shape([c[0] for c in cur.description], cur.fetchall())
    names, have = shape(df.columns, got)
    if names != want_names:
        return False, f"columns {names} != {want_names}", len(got), took
    if have != want:
        extra = [r for r in have if r not in set(want)][:3] if len(have) < 200000 else []
        lost = [r for r in want if r not in set(have)][:3] if len(want) < 200000 else []
        return False, f"rows {len(have)} vs {len(want)}; spark only {extra}; sql only {lost}", len(got), took
    kinds = {c[0]: str(c[1]) for c in cur.description}
    odd = [f"{n}:{k}" for n, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k]
    return True, "ok" + (f" (types {odd})" if odd else ""), len(got), took


def main() -> int:
    from merchlens.session import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark, con = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for name in names:
        try:
            ok, message, rows, took = compare(spark, con, queries[name], oracles.get(name), folder)
        except Exception as problem:  # noqa: BLE001
            ok, message, rows, took = False, f"{type(problem).__name__}: {str(problem)[:1500]}", 0, 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {rows:8d} rows {took:6.2f}s {'' if message == 'ok' else message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
