"""Spark-vs-DuckDB comparison in the driver's manner: same column names,
same row count, same multiset of rows (doubles compared at 1e-6 relative)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, (bool,)):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = _rows(spark_pdf), _rows(duck_pdf)
    for i, (x, y) in enumerate(zip(a, b)):
        if not all(_close(p, q) for p, q in zip(x, y)):
            return False, f"row {i} differs:\n spark {x}\n duck  {y}"
    return True, f"{len(a)} rows"


def run(keys=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    from prepark.session import local_session
    import __spark_entry__ as E

    spark = local_session(8)
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    results = {}
    for k in keys or qs:
        t0 = time.time()
        try:
            sp = qs[k](spark, sf_dir).toPandas()
            if k in sql:
                dk = con.execute(sql[k]).df()
                ok, msg = compare(sp, dk)
            else:
                ok, msg = True, f"rows-only: {len(sp)} rows"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:800]}"
        results[k] = ok
        print(f"{'OK ' if ok else 'BAD'} {k:24s} {time.time() - t0:6.1f}s  {msg}", flush=True)
    return results


if __name__ == "__main__":
    run(sys.argv[1:] or None)
