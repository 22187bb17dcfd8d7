"""Holds queries against their SQL: python tests/parity.py FOLDER [NAME...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from loamgraph.session import local_session  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("∅" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    mine = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(mine), None
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = canonical(mine, df.columns), canonical(theirs, names)
    if a == b:
        return len(mine), ""
    from collections import Counter

    x, y = Counter(a), Counter(b)
    return len(mine), f"rows {len(a)} / {len(b)}; only here {list((x - y).elements())[:3]}; only SQL {list((y - x).elements())[:3]}"


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8, 8), connect(folder)
    for n in names:
        t = time.time()
        try:
            rows, why = compare(spark, con, folder, n)
            print(f"{'ok' if why == '' else 'no SQL' if why is None else 'DIFF'} {n} {rows} rows {time.time() - t:.1f} s {why or ''}", flush=True)
        except Exception as e:
            print(f"ERROR {n}: {str(e)[:1500]}", flush=True)
