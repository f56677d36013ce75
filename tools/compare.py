"""Run registered queries in Spark and their SQL in DuckDB on the same files and compare the results.

usage: python tools/compare.py [scale] [name ...]
"""

from __future__ import annotations

import importlib.util
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from thermocline.session import build_session  # noqa: E402
from thermocline.sources.binding import BASE_TABLES  # noqa: E402


def same(left, right) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    names = sorted(left.columns)

    def cell(v):
        if pd.isna(v):
            return "null"
        return repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    rows = [sorted(tuple(map(cell, r)) for r in f[names].itertuples(index=False, name=None)) for f in (left, right)]
    for a, b in zip(*rows):
        if a != b:
            return f"{names}\n    {a}\n    {b}"
    return None


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in BASE_TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            middle = time.time()
            note = "no sql" if name not in sqls else same(got, duck.execute(sqls[name]).df()) or "ok"
        except Exception as e:  # a failing query must not hide the others
            middle, note, got = time.time(), f"ERROR {str(e)[:1500]}", []
        bad += note not in ("ok", "no sql")
        print(f"{name:32s} {len(got):8d} rows {middle - start:6.2f}s {time.time() - middle:6.2f}s  {note}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
