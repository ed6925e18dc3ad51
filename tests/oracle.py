"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def _sorted(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else what differs."""
    left_cols, left = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_cols, right = _sorted([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; first {left[:2]} / {right[:2]}"
    types = {c: set() for c in left_cols}
    bad = 0
    first = None
    for a, b in zip(left, right):
        if a != b:
            bad += 1
            first = first or (a, b)
        for c, x, y in zip(left_cols, a, b):
            if x is not None and y is not None and type(x) is not type(y):
                types[c].add((type(x).__name__, type(y).__name__))
    note = {c: t for c, t in types.items() if t}
    if note:
        return f"types {note}"
    if bad:
        return f"{bad}/{len(left)} rows differ; first {first}"
    return ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("gridwright-oracle")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    import gridwright.queries as q

    if os.environ.get("FAMILIES"):
        q.FAMILIES = tuple(os.environ["FAMILIES"].split(","))
    queries, sql = q.load()
    names = [n for n in queries if not argv or any(n.startswith(p) for p in argv)]
    spark, con = session(), connect(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf)
            if n in sql:
                msg = compare(df, con, sql[n])
            else:
                rows = df.count()
                msg = "" if rows else "no rows"
        except Exception as e:
            msg = f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(msg)
        kind = "sql " if n in sql else "rows"
        print(f"{'FAIL' if msg else 'ok  '} {kind} {time.time() - t0:6.2f}s {n} {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
