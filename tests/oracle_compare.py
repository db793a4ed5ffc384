"""Spark-vs-DuckDB comparison used by the tests and by hand (python tests/oracle_compare.py [names])."""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records):
    return sorted((tuple(_norm(x) for x in r) for r in records), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = rows_of(s_rows), rows_of(d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({len(s_rows)} rows), first: {diff}"
    return True, f"{len(s_rows)} rows"


if __name__ == "__main__":
    from knockon.plans import catalog
    from knockon.session import get_spark
    sf = os.environ.get("KNOCKON_TEST_SF", "/root/testdata/sf0.01")
    spark = get_spark("oracle", master="local[8]", shuffle_partitions=8)
    con = duck(sf)
    names = sys.argv[1:] or list(catalog.ORACLES)
    bad = 0
    for n in names:
        if n not in catalog.ORACLES:
            print(f"{n}: no oracle (rows={catalog.QUERIES[n](spark, sf).count()})")
            continue
        try:
            ok, msg = compare(spark, con, n, catalog.QUERIES[n], catalog.ORACLES[n], sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n}: {msg}", flush=True)
    print("failures:", bad)
