"""Compare catalogue queries with their SQL twins. ``python tests/check_oracle.py [sf] [name ...]``"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from annalist.plans.standins import NAMES  # noqa: E402
from annalist.session import build_session  # noqa: E402


#: Text similarity and chained decisions have no SQL form; the tests hold these jobs against brute force.
NO_TWIN = ("document_dedup_chained", "event_resolution", "event_matches", "run_summary")


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in (*NAMES, "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (int, bool, str)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def check(spark, con, name: str, folder: str) -> tuple[bool, str]:
    began = time.time()
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    took = time.time() - began
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return name in NO_TWIN or name.startswith(("op", "pipeline")), f"{len(got)} rows, no SQL twin, {took:.1f}s"
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        extra = [x for x in a if x not in b][:3] if len(a) < 20000 else []
        missing = [x for x in b if x not in a][:3] if len(b) < 20000 else []
        return False, f"{len(a)} vs {len(b)} rows; spark only {extra}; sql only {missing}"
    return True, f"{len(a)} rows, {took:.1f}s"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    session, con = build_session(), connect(folder)
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for n in names:
        try:
            ok, note = check(session, con, n, folder)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print("ok  " if ok else "BAD ", n, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    sys.exit(1 if bad else 0)
