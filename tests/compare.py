"""Run registered queries in Spark and DuckDB on the same tables and compare them."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) >= 1e6 else f"{v:.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time() - t
    if sql is None:
        return len(left), None, t1, 0.0, "rows only"
    t = time.time()
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    right = rows_of(cols, cur.fetchall())
    t2 = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return len(left), len(right), t1, t2, f"columns {sorted(df.columns)} / {sorted(cols)}"
    if left == right:
        return len(left), len(right), t1, t2, ""
    a, b = set(left), set(right)
    return len(left), len(right), t1, t2, f"differ {len(a - b)}/{len(b - a)}: {sorted(a - b)[:3]} <> {sorted(b - a)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pourscale.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    from pyspark.sql import SparkSession

    SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark = build_session(partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            n1, n2, t1, t2, err = compare(spark, con, sf, fn, sqls.get(name))
        except Exception as ex:
            n1, n2, t1, t2, err = -1, -1, 0, 0, str(ex)[:1500]
        bad += bool(err) and err != "rows only"
        print(f"{'ok ' if not err else 'BAD'} {name} {n1} {n2} {t1:.1f}s {t2:.1f}s {err}", flush=True)
    print("bad", bad)
