"""Run each registered query in Spark and its SQL twin in DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares column names, row counts and values (order-insensitive; floats to
9 significant digits).  Prints one line per query and a summary.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "<null>"
    if isinstance(v, (bool, np.bool_)):
        return repr(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        f = float(v)
        if math.isnan(f):
            return "<null>"
        return f"{f:.9g}"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    return repr(v)


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    a, b = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if a != b:
        return f"COLUMNS spark-only={sorted(set(a) - set(b))} duck-only={sorted(set(b) - set(a))}"
    if len(spark_pdf) != len(duck_pdf):
        return f"ROWS spark={len(spark_pdf)} duck={len(duck_pdf)}"
    ca, cb = canon(spark_pdf), canon(duck_pdf)
    if ca != cb:
        bad = [(x, y) for x, y in zip(ca, cb) if x != y][:2]
        return f"VALUES first diffs: {bad}"
    return "OK"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from logsleuth.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    fails = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            sp = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            fails += 1
            continue
        dt = time.time() - t
        if name not in sqls:
            print(f"{name:24s} rows-only {len(sp)} rows  {dt:.1f}s")
            continue
        try:
            dd = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:24s} DUCK-ERROR {str(e)[:300]}")
            fails += 1
            continue
        res = compare(sp, dd)
        fails += res != "OK"
        print(f"{name:24s} {res[:600]}  ({len(sp)} rows, {dt:.1f}s)")
    print(f"failures: {fails}")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
