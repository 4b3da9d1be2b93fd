"""Run every registered query next to its oracle: ``python -m suite.check [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

from gleanframe.session import local_session
from suite import all_oracles, all_queries


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(names, rows):
    """Rows as sorted tuples with columns in name order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def compare_one(spark, connection, folder, run, sql):
    """``None`` when the results agree, else what differs."""
    frame = run(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    if sql is None:
        return None
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        return "values differ: " + "; ".join(
            f"{a} != {b}" for a, b in list(zip(got, want)) if a != b
        )[:1500]
    return None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls, failed = oracle(folder), all_oracles(), 0
    for name, run in all_queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = compare_one(spark, connection, folder, run, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1200]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
