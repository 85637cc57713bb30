"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows as multisets.

    python tests/oracle.py [--sf DIR] [name …]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)) or (isinstance(v, float) and math.isfinite(v)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """(ok, text) for one query."""
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return False, f"{len(got)} vs {len(want)} rows\n   spark only: {sorted(a - b)[:2]}\n   sql only:   {sorted(b - a)[:2]}"
    return True, f"{len(got)} rows equal"


def main():
    from wardlight.session import build_session

    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("oracle", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                   "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(args.sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            ok, text = compare(spark, con, fn, oracles.get(name), args.sf)
        except Exception as e:   # keep going: the list of failures is what one wants to see
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
