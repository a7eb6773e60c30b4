"""Compares registered queries with their SQL: python tests/oracle_check.py <sf_dir> [name part …]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from palimpsest.plans.catalog import NAMES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    return v


def duck(folder: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, fn, sql: str) -> str:
    """An empty string, or what differs."""
    df = fn(spark, folder)
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(type(v) is bool), str(v)) for v in r)
    got.sort(key=key), want.sort(key=key)
    if got == want:
        return ""
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)} / {len(want)}; columns {cols}\n   only here {extra}\n   only sql {missing}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder, parts = sys.argv[1], sys.argv[2:]
    con, sqls, bad = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in sqls:
                res = compare(spark, con, folder, name, fn, sqls[name])
            else:
                res = "" if fn(spark, folder).count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            res = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(res)
        print(f"{'FAIL' if res else 'ok  '} {name} {'sql' if name in sqls else 'rows'} {time.time() - t:.1f}s {res}", flush=True)
    print("failures", bad)
