"""Compare catalogue queries with their DuckDB oracle SQL.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: rows, columns and value-hash agreement.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v, exact: bool):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(v) if exact else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x, exact) for x in v) + "]"
    return str(v)


def digest(cols: list[str], rows: list[tuple], exact: bool = True) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i], exact) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, sf_dir: str, names=None, con=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = con or duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            out[name] = ("SPARK-ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:28s} SPARK-ERROR {out[name][1]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            out[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name:28s} rows-only  spark={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            out[name] = ("SQL-ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:28s} SQL-ERROR {out[name][1]}", flush=True)
            continue
        same_cols = sorted(scols) == sorted(dcols)
        exact = digest(scols, srows) == digest(dcols, drows)
        approx = exact or digest(scols, srows, False) == digest(dcols, drows, False)
        status = "OK" if (same_cols and exact) else ("APPROX" if same_cols and approx else "MISMATCH")
        out[name] = (status, len(srows), len(drows))
        if verbose:
            extra = "" if same_cols else f" cols spark={sorted(scols)} duck={sorted(dcols)}"
            print(f"{name:28s} {status:8s} spark={len(srows)} duck={len(drows)} {ts:.1f}s{extra}", flush=True)
            if status == "MISMATCH" and same_cols:
                _show_diff(scols, srows, dcols, drows)
    return out


def _show_diff(scols, srows, dcols, drows, k=3):
    order_s = sorted(range(len(scols)), key=lambda i: scols[i])
    order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
    s = {"|".join(_canon(r[i], True) for i in order_s) for r in srows}
    d = {"|".join(_canon(r[i], True) for i in order_d) for r in drows}
    print("   cols:", sorted(scols))
    for x in sorted(s - d)[:k]:
        print("   spark only:", x[:400])
    for x in sorted(d - s)[:k]:
        print("   duck  only:", x[:400])


if __name__ == "__main__":
    from veeduria.session import ensure_checkpoint_dir, get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "rows-only")}
    print(f"TOTAL {len(res)}  ok={sum(v[0] == 'OK' for v in res.values())} "
          f"rows-only={sum(v[0] == 'rows-only' for v in res.values())} bad={len(bad)}")
