"""Run registered queries beside their SQL statements and compare rows, columns and values.

Usage: python -m tests.oracle [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_duckdb(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(plain(row[i])) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, name, folder, queries, oracles):
    """Returns (ok, message)."""
    df = queries[name](spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(oracles[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        have, need = set(got), set(want)
        diff_got = [r for r in got if r not in need][:3]
        diff_want = [r for r in want if r not in have][:3]
        return False, f"{len(got)} vs {len(want)} rows\n   spark {diff_got}\n   sql   {diff_want}"
    return True, f"{len(got)} rows equal"


def main() -> int:
    import __spark_entry__ as entry
    from tidewell.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args.names or queries:
        start = time.time()
        try:
            ok, message = compare(spark, con, name, folder, queries, oracles)
        except Exception as error:  # report every query, then fail
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {message}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
