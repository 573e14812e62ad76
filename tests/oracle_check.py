"""Compare registered queries with their SQL on DuckDB.  `python tests/oracle_check.py [prefix ...]`."""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}" if v != 0 else "0.000000"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t0
    if sql is None:
        return ("rows-only", len(got), dt, "")
    timer = threading.Timer(float(os.environ.get("SQL_TIMEOUT", "40")), con.interrupt)
    timer.start()
    try:
        rel = con.execute(sql)
    finally:
        timer.cancel()
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return ("COLUMNS", len(got), dt, f"{sorted(df.columns)} vs {sorted(cols)}")
    kinds_a = {c: t for c, t in df.dtypes}
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return ("ok" if got else "EMPTY", len(got), dt, "")
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return ("DIFF", len(got), dt, f"rows {len(a)} vs {len(b)}; cols {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}\n   {kinds_a}")


def main(argv):
    import __spark_entry__ as entry
    from tests.session import make_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(sf_dir)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            status, n, dt, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as ex:  # report and go on to the next query
            status, n, dt, note = "ERROR", 0, 0.0, f"{type(ex).__name__}: {str(ex)[:900]}"
        if status not in ("ok", "rows-only"):
            bad += 1
        total = time.time() - t0
        if status != "ok" or total > 8 or os.environ.get("VERBOSE"):
            print(f"{status:10s} {name:36s} n={n:<7d} {dt:6.2f}s of {total:.1f}s {note}", flush=True)
    print("checked", "failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
