"""Runs queries() against oracle_sql() in DuckDB: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def spark_session(shuffle: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .appName("tablewright-tests")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)[:19]
    return str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def compare(spark, con, sf_dir, name, fn, sql):
    """``None`` when equal, else a short text about the difference."""
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.collect(), df.columns)
    if sql is None:
        return None
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want, want_cols = rows_of(cur.fetchall(), want_cols)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {got_cols} {bad[0][0]} != {bad[0][1]}"
    if not got:
        return "no rows"
    return None


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            diff = compare(spark, con, sf_dir, name, queries[name], sqls.get(name))
        except Exception as e:  # report every query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        failed += diff is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {diff or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
