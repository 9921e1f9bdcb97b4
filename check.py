"""Compare registered queries with their DuckDB SQL: python check.py [-s SF] [-k PREFIX,...]"""

import argparse
import math
import sys
import time
import traceback

import duckdb

from netloom.catalog import load
from netloom.catalog.standins import TABLES
from netloom.session import local_session


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v if isinstance(v, (int, bool, str)) else str(v)


def rows(cols, data):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in idx) for r in data), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-k", default="")
    ap.add_argument("--missing", action="store_true")
    a = ap.parse_args()
    q, o = load()
    keys = [k for k in q if not a.k or any(k.startswith(p + "_") or k == p or (p.endswith("*") and k.startswith(p[:-1])) for p in a.k.split(","))]
    sf = f"/root/testdata/sf{a.s}"
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            df = q[k](spark, sf)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if k not in o:
                print(f"{k:34s} rows-only {len(got):7d}  {t1 - t0:6.2f}s {got[:1] if len(got) < 3 else ''}", flush=True)
                continue
            cur = con.execute(o[k])
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            assert sorted(cols) == sorted(df.columns), f"columns {sorted(df.columns)} vs {sorted(cols)}"
            A, B = rows(df.columns, got), rows(cols, want)
            if A != B:
                diff = [(x, y) for x, y in zip(A, B) if x != y][:3]
                raise AssertionError(f"rows {len(A)} vs {len(B)}; {diff}")
            print(f"{k:34s} OK {len(got):7d}  {t1 - t0:6.2f}s duck {time.time() - t1:5.2f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(k)
            print(f"{k:34s} FAIL {type(e).__name__}: {str(e)[:1500]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print(f"{len(keys) - len(bad)}/{len(keys)} good; bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
