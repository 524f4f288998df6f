"""Run registered queries on Spark and their DuckDB oracle SQL; compare results.

Usage: python tools/oracle_check.py [--sf DIR] [name-substring ...]
Compares column names (sorted), row counts and an order-insensitive multiset of
normalized rows (floats rounded to 6 places).
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, int):
        return float(v) if False else v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--json", default=None)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from tessera.plans import load_all
    from tessera.session import get_spark
    queries, oracles = load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duck(a.sf)
    results = {}
    names = [n for n in queries if not a.names or any(s in n for s in a.names)]
    for name in names:
        rec = {}
        t0 = time.time()
        try:
            df = queries[name](spark, a.sf)
            scols = df.columns
            srows = df.collect()
            rec["spark_rows"] = len(srows)
            rec["spark_sec"] = round(time.time() - t0, 2)
        except Exception as e:  # noqa: BLE001
            rec["error"] = f"spark: {type(e).__name__}: {str(e)[:300]}"
            results[name] = rec
            print(name, rec, flush=True)
            continue
        if name in oracles:
            try:
                cur = con.execute(oracles[name])
                ocols = [d[0] for d in cur.description]
                orows = cur.fetchall()
                rec["oracle_rows"] = len(orows)
                rec["cols_match"] = sorted(scols) == sorted(ocols)
                if not rec["cols_match"]:
                    rec["cols"] = [sorted(scols), sorted(ocols)]
                rec["values_match"] = rec["cols_match"] and rows_of(scols, srows) == rows_of(ocols, orows)
                if rec["cols_match"] and not rec["values_match"]:
                    a_, b_ = rows_of(scols, srows), rows_of(ocols, orows)
                    diff_a = [r for r in a_ if r not in set(b_)][:2]
                    diff_b = [r for r in b_ if r not in set(a_)][:2]
                    rec["diff"] = [str(diff_a)[:400], str(diff_b)[:400]]
            except Exception as e:  # noqa: BLE001
                rec["error"] = f"oracle: {type(e).__name__}: {str(e)[:300]}"
        else:
            rec["oracle"] = "none (rows-only)"
        results[name] = rec
        ok = rec.get("values_match", rec.get("oracle") is not None and "error" not in rec)
        print(("OK  " if ok else "FAIL"), name, json.dumps(rec, default=str), flush=True)
    if a.json:
        with open(a.json, "w") as f:
            json.dump(results, f, indent=1, default=str)
    bad = [n for n, r in results.items() if "error" in r or r.get("values_match") is False]
    print(f"{len(results) - len(bad)}/{len(results)} ok; failing: {bad}")


if __name__ == "__main__":
    main()
