"""Run queries() against oracle_sql() with DuckDB, as the driver does.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), sorted(cols)


def compare(spark, con, key, qfn, sql, sf_dir):
    t0 = time.time()
    df = qfn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    s, scols = rows_of(df.columns, srows)
    if sql is None:
        return f"{key}: rows={len(s)} (no oracle) {t1 - t0:.2f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    d, dcols = rows_of(dcols, res.fetchall())
    ok = scols == dcols and s == d
    msg = f"{key}: {'OK' if ok else 'MISMATCH'} spark={len(s)} duck={len(d)} {t1 - t0:.2f}s"
    if not ok:
        if scols != dcols:
            msg += f"\n   cols spark={scols} duck={dcols}"
        else:
            sd = set(s) - set(d)
            ds = set(d) - set(s)
            msg += f"\n   spark-only={list(sd)[:3]}\n   duck-only={list(ds)[:3]}"
    return msg


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    import __spark_entry__ as E
    from sqlweave.session import get_spark
    spark = get_spark()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k, f in qs.items():
        if keys and k not in keys:
            continue
        try:
            msg = compare(spark, con, k, f, sqls.get(k), sf_dir)
        except Exception as e:  # report and continue
            msg = f"{k}: ERROR {type(e).__name__}: {str(e)[:400]}"
        if "OK" not in msg and "no oracle" not in msg:
            bad += 1
        print(msg, flush=True)
    print(f"bad={bad}")


if __name__ == "__main__":
    main()
