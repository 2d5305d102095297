"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/compare.py [--sf DIR] [--plan] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides give the same rows, else a short description."""
    cursor = con.execute(sql)
    theirs_columns = [c[0] for c in cursor.description]
    theirs = rows_of(theirs_columns, cursor.fetchall())
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    if not ours:
        return "no rows"
    different = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    if different:
        return f"{len(different)} of {len(ours)} rows differ; ours {different[0][0]} theirs {different[0][1]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--plan", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from casemill.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duck(args.sf)
    oracle = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        started = time.time()
        try:
            df = fn(spark, args.sf)
            if args.plan:
                df.explain("formatted")
            if name in oracle:
                verdict = difference(df, con, oracle[name])
            else:
                count = len(df.collect())
                verdict = None if count else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - started:.2f}s {verdict or ''}"
              f"{'' if name in oracle else ' (rows only)'}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
