"""Compare every registered query with its oracle: python -m checks.run [sf] [name-part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from pingframe.session import build_session

from . import load_all
from .registry import ORACLES, QUERIES
from .views import TABLES


def canonical(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main(argv):
    sf = argv[0] if argv else "0.01"
    parts = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    load_all()
    spark = build_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.perf_counter()
        try:
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            cols, took = df.columns, time.perf_counter() - t0
            if name not in ORACLES:
                print(f"rows {len(got):7d}  {took:6.2f}s  {name}", flush=True)
                continue
            t1 = time.perf_counter()
            cur = con.execute(ORACLES[name])
            ocols = [d[0] for d in cur.description]
            want = cur.fetchall()
            otook = time.perf_counter() - t1
            if sorted(cols) != sorted(ocols):
                raise AssertionError(f"columns {sorted(cols)} vs {sorted(ocols)}")
            a, b = rows_of(cols, got), rows_of(ocols, want)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                raise AssertionError(f"{len(a)} vs {len(b)} rows; {diff or (a[:2], b[:2])}")
            stypes = {f.name: f.dataType.simpleString() for f in df.schema}
            dtypes = {d[0]: str(d[1]) for d in cur.description}
            note = "" if len(a) else "  EMPTY"
            print(f"ok   {len(a):7d}  {took:6.2f}s (oracle {otook:5.2f}s)  {name}{note}", flush=True)
            odd = [(c, stypes[c], dtypes[c]) for c in cols if (stypes[c], dtypes[c]) in (("int", "BIGINT"), ("bigint", "INTEGER"), ("double", "BIGINT"))]
            if odd:
                print("       types", odd)
        except Exception as e:  # noqa: BLE001 - report and go on
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
