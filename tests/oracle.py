"""Compare every named query with its plain SQL in DuckDB.

Usable as a script: python -m tests.oracle [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalized(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, type(v).__name__, str(v)) for v in r))


def differences(df, sql: str, connection) -> list[str]:
    """What differs between a Spark result and the SQL result; empty when they agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = normalized(names, result.fetchall())
    actual = normalized(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(expected) != len(actual):
        found.append(f"rows {len(actual)} != {len(expected)}")
    kinds_a = [{type(v).__name__ for v in c if v is not None} for c in zip(*actual)]
    kinds_e = [{type(v).__name__ for v in c if v is not None} for c in zip(*expected)]
    if kinds_a != kinds_e:
        found.append(f"types {kinds_a} != {kinds_e}")
    if expected != actual:
        pairs = [(a, e) for a, e in zip(actual, expected) if a != e]
        found.append(f"{len(pairs)} rows differ, first: {pairs[:1]} columns {sorted(names)}")
    return found


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from factloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("oracle", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    names = sys.argv[2:] or list(queries())
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            sql = oracle_sql().get(name)
            found = differences(df, sql, connection) if sql else [] if df.count() >= 0 else []
            note = "" if sql else " (no SQL)"
        except Exception as e:  # noqa: BLE001  (report and go on with the next query)
            found, note = [f"{type(e).__name__}: {str(e)[:900]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s{note} {found or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
