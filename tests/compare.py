"""Runs registered queries beside their SQL on DuckDB: ``python tests/compare.py SF_DIR [NAME PREFIX ...]``."""

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return c


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got), None
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, len(got), f"columns {sorted(df.columns)} / {sorted(cols)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, len(got), f"{len(got)} / {len(want)} rows, {sorted(cols)} {diff}"
    return True, len(got), None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sys.argv[1]), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if sys.argv[2:] and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t = time.time()
        try:
            ok, n, why = compare(spark, con, fn, oracle.get(name), sys.argv[1])
        except Exception as x:
            ok, n, why = False, -1, str(x)[:600]
        print({True: "ok  ", False: "BAD ", None: "rows"}[ok], name, n, f"{time.time() - t:.1f}s", why or "", flush=True)
        if ok is False:
            bad.append(name)
    print("bad:", bad)
