"""Side-by-side check of a registered query against its DuckDB oracle, the
way the driver does it: same columns, same row count, same values (rows
sorted, columns sorted by name)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not hasattr(v, "to_pydatetime"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return round(v, 9)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict, con=None, show: int = 5) -> bool:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir).toPandas()
    t1 = time.time()
    con = con or duck(sf_dir)
    odf = con.execute(oracles[name]).df()
    t2 = time.time()
    ok = True
    if sorted(sdf.columns) != sorted(odf.columns):
        print(f"[{name}] columns differ: spark={sorted(sdf.columns)} oracle={sorted(odf.columns)}")
        return False
    if len(sdf) != len(odf):
        print(f"[{name}] rows differ: spark={len(sdf)} oracle={len(odf)}")
        ok = False
    a, b = frame_rows(sdf), frame_rows(odf)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        ok = False
        print(f"[{name}] {len(diff)} differing rows; columns {sorted(sdf.columns)}")
        for x, y in diff[:show]:
            print("  spark :", x)
            print("  oracle:", y)
    print(f"[{name}] {'OK' if ok else 'MISMATCH'} rows={len(sdf)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s")
    return ok


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from sparkbars.session import build

    sf = sys.argv[1]
    names = sys.argv[2:] or sorted(E.oracle_sql())
    spark = build("local[8]")
    con = duck(sf)
    Q, O = E.queries(), E.oracle_sql()
    bad = [n for n in names if n in O and not compare(spark, n, sf, Q, O, con)]
    print("FAILED:", bad if bad else "none")
