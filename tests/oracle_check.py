"""Compare every query with its expected-result statement in DuckDB.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from hammertrail.sources.views import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=str)


def compare(spark_df, con, sql: str) -> str:
    got_names, got = rows_of(spark_df.columns, spark_df.collect())
    res = con.execute(sql)
    want_names, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns differ: {got_names} / {want_names}"
    if got == want:
        return ""
    missing = [r for r in want if r not in set(got)][:3]
    extra = [r for r in got if r not in set(want)][:3]
    return f"rows {len(got)} / {len(want)}; {got_names}; missing {missing}; extra {extra}"


def main() -> int:
    from hammertrail.session import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    unknown = set(oracles) - set(queries)
    failed = len(unknown)
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                tag = "ok" if not problem else "FAIL"
            else:
                problem, tag = f"{df.count()} rows", "rows"
        except Exception as exc:  # noqa: BLE001
            problem, tag = f"{type(exc).__name__}: {str(exc)[:600]}", "FAIL"
        failed += tag == "FAIL"
        print(f"{tag:5} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"failed {failed} {sorted(unknown)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
