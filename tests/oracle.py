"""Side-by-side check of registered queries against DuckDB.

Usage: python -m tests.oracle [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def key(row):
    return tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def spark_rows(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    names = [df.columns[i] for i in order]
    return names, sorted([tuple(plain(r[i]) for i in order) for r in df.collect()], key=key)


def duck_rows(con, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in found.fetchall()], key=key)


def difference(df, con, sql) -> str | None:
    """First difference between a Spark result and its SQL counterpart, or None."""
    names, left = spark_rows(df)
    expected, right = duck_rows(con, sql)
    if names != expected:
        return f"columns {names} != {expected}"
    if len(left) != len(right):
        extra = [r for r in left[:5] if r not in set(right)] if len(left) < 200000 else []
        return f"rows {len(left)} != {len(right)} {extra[:2]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[0][0]} != {wrong[0][1]}"
    return None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    from folioscope.session import build_session

    import __spark_entry__ as entry

    spark = build_session("local[8]", 8, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = []
    for name, build in entry.queries().items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in sql:
                found = difference(build(spark, folder), con, sql[name])
                status = found or "ok"
            else:
                status = f"rows only: {len(build(spark, folder).collect())}"
        except Exception as e:  # noqa: BLE001
            status = f"{type(e).__name__}: {str(e)[:600]}"
        if not (status == "ok" or status.startswith("rows only")):
            bad.append(name)
        print(f"{name:40s} {time.time() - start:6.2f}s {status}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
