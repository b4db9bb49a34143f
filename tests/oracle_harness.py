"""Run registered queries in Spark and their SQL oracles in DuckDB; compare
row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        if float(v).is_integer():
            return int(v)
        return round(float(v), 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, np.integer | int) and not isinstance(v, bool):
        return int(v)
    if isinstance(v, pd.Timestamp | dt.datetime):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo else pd.Timestamp(v).isoformat()
    if isinstance(v, np.ndarray | list | tuple):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def digest(df: pd.DataFrame) -> tuple[list[str], int, str]:
    cols = sorted(df.columns)
    rows = [repr(tuple(_norm(r[c]) for c in cols)) for r in df[cols].to_dict("records")]
    rows.sort()
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or qs:
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(name, "SPARK ERROR", str(e)[:400], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(sdf))
            if verbose:
                print(f"{name:28s} rows-only {len(sdf)} ({ts:.1f}s)", flush=True)
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", str(e)[:400])
            if verbose:
                print(name, "SQL ERROR", str(e)[:400], flush=True)
            continue
        a, b = digest(sdf), digest(odf)
        ok = a == b
        results[name] = ("ok" if ok else "MISMATCH", a[1], b[1])
        if verbose:
            print(f"{name:28s} {'ok' if ok else 'MISMATCH'} spark={a[1]} sql={b[1]} ({ts:.1f}s)"
                  + ("" if a[0] == b[0] else f" cols {a[0]} vs {b[0]}"), flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from postloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session()
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("ok", "rows-only")}
    print("SUMMARY", len(res), "queries,", len(bad), "bad:", sorted(bad))
