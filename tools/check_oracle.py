"""Compare every registered Spark query with its DuckDB oracle (row count,
column names, order-insensitive values), like the driver's correctness gate.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from codepref.plans.catalog import ORACLES, QUERIES, load_all  # noqa: E402
from codepref.session import local_session  # noqa: E402
from codepref.sources.tables import DRIVER_TABLES  # noqa: E402


STRICT = bool(os.environ.get("ORACLE_STRICT"))


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (v if STRICT else round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in records]


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    load_all()
    spark = local_session()
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or sorted(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf)
            cols = df.columns
            srows = rows_of(cols, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"{name:28s} rows={len(srows):6d} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.sql(ORACLES[name])
            ocols = res.columns
            orows = rows_of(ocols, res.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ORACLE ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(srows) == len(orows)
        ok_v = Counter(map(repr, srows)) == Counter(map(repr, orows))
        status = "OK" if ok_cols and ok_n and ok_v else "MISMATCH"
        if status != "OK":
            bad += 1
        print(f"{name:28s} {status:8s} rows={len(srows)}/{len(orows)} cols={ok_cols} vals={ok_v} {ts:.1f}s")
        if status != "OK" and ok_cols:
            a, b = Counter(map(repr, srows)), Counter(map(repr, orows))
            for x in list((a - b).keys())[:2]:
                print("   spark only:", x[:400])
            for x in list((b - a).keys())[:2]:
                print("   oracle only:", x[:400])
        elif not ok_cols:
            print("   spark cols:", sorted(cols), "\n   oracle cols:", sorted(ocols))
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
