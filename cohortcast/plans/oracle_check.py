"""Local re-implementation of the driver's correctness gate: run a registered query
on Spark and its SQL on DuckDB over the same parquet files, compare row count,
column names/types and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import os
import time

import duckdb
import pandas as pd

from ..sources.tables import TABLES

_SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN", "ShortType": "SMALLINT", "FloatType": "FLOAT", "DateType": "DATE",
}


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _hash_frame(df: pd.DataFrame) -> str:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(pd.notna(df), "NULL")
    rows = sorted("|".join(repr(v) for v in r) for r in df.itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, q, sf_dir: str, con=None) -> dict:
    con = con or duck_connection(sf_dir)
    t0 = time.time()
    sdf = q.spark_df(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    sql = q.oracle()
    out = {"name": q.name, "spark_rows": len(spdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    ddf = con.execute(sql).df()
    out["duck_rows"] = len(ddf)
    s_types = {f.name: _SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in sdf.schema.fields}
    d_types = dict(zip([d[0] for d in con.execute(f"DESCRIBE {sql}").fetchall()],
                       [d[1] for d in con.execute(f"DESCRIBE {sql}").fetchall()]))
    out["cols_match"] = sorted(s_types) == sorted(d_types)
    if q.name != "rmse_table":  # its country columns are data-dependent and rounded generically
        undeclared = sorted(k for k, v in s_types.items() if v == "DOUBLE" and k not in q.doubles)
        if undeclared:
            out["undeclared_doubles"] = undeclared
    out["type_diffs"] = {k: (s_types.get(k), d_types.get(k)) for k in set(s_types) | set(d_types) if s_types.get(k) != d_types.get(k)}
    ok = out["cols_match"] and len(spdf) == len(ddf)
    if ok:
        hs, hd = _hash_frame(spdf), _hash_frame(ddf[list(spdf.columns)])
        out["hash_match"] = hs == hd
        if hs != hd:
            a = spdf.sort_values(list(spdf.columns)).reset_index(drop=True)
            b = ddf[list(spdf.columns)].sort_values(list(spdf.columns)).reset_index(drop=True)
            diffs = []
            for c in spdf.columns:
                m = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
                if m.any():
                    diffs.append((c, int(m.sum()), a.loc[m, c].head(3).tolist(), b.loc[m, c].head(3).tolist()))
            out["diffs"] = diffs[:6]
    good = ok and out.get("hash_match") and not out["type_diffs"] and not out.get("undeclared_doubles")
    out["status"] = "ok" if good else "MISMATCH"
    return out


def main(argv=None) -> int:
    import argparse
    import json

    from ..session import local_session
    from .registry import all_queries

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args(argv)
    spark = local_session()
    reg = all_queries()
    con = duck_connection(args.sf)
    bad = 0
    for name, q in reg.items():
        if args.names and name not in args.names:
            continue
        try:
            r = compare(spark, q, args.sf, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "ERROR", "error": str(e)[:800]}
        bad += r["status"] not in ("ok", "rows-only")
        print(json.dumps(r, default=str), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
