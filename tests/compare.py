"""Run registered queries beside their SQL and compare the values.

``python tests/compare.py <folder> [name …]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import tempfile
import threading
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def make_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("tierlift")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tierlift-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
                out.append("null")
            elif hasattr(v, "item"):
                v = v.item()
                out.append("null" if v != v else repr(v))
            else:
                out.append(repr(v))
        rows.append(tuple(out))
    return sorted(rows)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    left, right = left.copy(), right.copy()
    for c in left.columns:
        # Integers with nulls reach pandas as doubles from one side and as integers from the other.
        kinds = {pd.api.types.is_float_dtype(x[c]): x for x in (left, right)}
        if len(kinds) == 2 and pd.api.types.is_integer_dtype(kinds[False][c]):
            kinds[True][c] = kinds[True][c].astype("Int64")
    a, b = canonical(left), canonical(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0][0]} / {bad[0][1]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(folder)
    oracle, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - started
            if name in oracle:
                s2 = time.time()
                guard = threading.Timer(120, con.interrupt)
                guard.start()
                problem = differences(got, con.execute(oracle[name]).fetchdf())
                guard.cancel()
                t2 = time.time() - s2
            else:
                problem, t2 = None, 0.0
            failed += problem is not None
            kind = "rows" if name not in oracle else "ok" if problem is None else "DIFF"
            print(f"{kind:5} {name:26} {len(got):7} rows {took:6.1f}s sql {t2:5.1f}s "
                  f"{problem or ''}"[:700], flush=True)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL  {name:26} {str(e)[:1200]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
