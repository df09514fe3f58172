"""Run registered queries next to their DuckDB SQL and report differences.

``python tests/check.py [--sf DIR] [name ...]``
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return str(v)

    out = pdf.map(cell) if len(pdf.columns) else pdf
    return out.sort_values(list(out.columns), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}\n{got.head(3).to_string()}\n{want.head(3).to_string()}"
    a, b = canon(got), canon(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        rows = bad[bad].index[:3]
        return "\n".join(
            f"  row {i} {c}: {a.at[i, c][:160]!r} != {b.at[i, c][:160]!r}"
            for i in rows for c in a.columns if a.at[i, c] != b.at[i, c]
        )
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import importlib

    from docflow.registry import base

    if args.module:
        importlib.import_module(f"docflow.registry.{args.module}")
        fns, sqls = base.QUERIES, base.ORACLES
        if not args.names:
            args.names = [n for n, f in fns.items() if f.__module__.endswith("." + args.module)]
    else:
        from docflow.registry import load

        fns, sqls = load()
    spark, con = make_session(), make_duck(args.sf)
    bad = 0
    for name in args.names or list(fns):
        t = time.time()
        try:
            df = fns[name](spark, args.sf)
            got = df.toPandas()
            spent = time.time() - t
            t = time.time()
            if name in sqls:
                want = con.sql(sqls[name]).df()
                diff = differences(got, want)
                types = {c: str(x) for c, x in df.dtypes}
                mark = "ok  " if diff is None else "DIFF"
            else:
                diff, mark, types = None, "rows", {}
            print(f"{mark} {name:28s} rows={len(got):7d} spark={spent:6.2f}s duck={time.time() - t:5.2f}s", flush=True)
            odd = [f"{c}:{x}" for c, x in types.items() if x.startswith(("array", "map", "struct", "variant", "decimal"))]
            if odd:
                print("     odd types", odd)
            if diff:
                bad += 1
                print(diff)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(e)[:700]}", flush=True)
    print("bad", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
