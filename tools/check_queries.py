"""Run registered queries and compare them with their SQL checks.

usage: check_queries.py [--sf DIR] [--show] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from surveyloom import queries as registry  # noqa: E402
from surveyloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def types_of(values):
    return {type(v).__name__ for v in values if v is not None}


def compare(spark, con, name, sf):
    """(verdict, seconds, rows)"""
    started = time.time()
    df = registry.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = registry.CHECKS.get(name)
    if sql is None:
        return "rows only", seconds, len(rows), ""
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_c, got = sorted_rows(df.columns, rows)
    want_c, want = sorted_rows(want_columns, want)
    if got_c != want_c:
        return "COLUMNS", seconds, len(rows), f"{got_c} != {want_c}"
    for i, c in enumerate(got_c):
        a, b = types_of(r[i] for r in got), types_of(r[i] for r in want)
        if a != b:
            return "TYPES", seconds, len(rows), f"{c}: {a} != {b}"
    if got != want:
        only_got = [r for r in got if r not in set(map(lambda x: x, want))][:3] if len(got) < 20000 else got[:2]
        only_want = [r for r in want if r not in set(got)][:3] if len(got) < 20000 else want[:2]
        return "VALUES", seconds, len(rows), f"{len(got)} vs {len(want)} rows\n  spark {only_got}\n  sql   {only_want}"
    return "ok", seconds, len(rows), ""


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    registry.load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in registry.QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            verdict, seconds, n, note = compare(spark, con, name, args.sf)
        except Exception as e:  # noqa: BLE001
            verdict, seconds, n, note = "ERROR", 0.0, 0, "\n".join(str(e).splitlines()[:8]) + "\n" + "".join(traceback.format_tb(e.__traceback__)[-2:])
        bad += verdict not in ("ok", "rows only")
        print(f"{verdict:10} {name:28} {n:8} rows {seconds:7.2f}s {note}", flush=True)
        if args.show:
            registry.QUERIES[name](spark, args.sf).show(8, False)
    print("failed:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
