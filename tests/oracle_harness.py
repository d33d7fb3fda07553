"""Compare catalogue queries with their DuckDB oracle the way the driver does:
row count, column names/types and an order-insensitive hash of the values.

    python tests/oracle_harness.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(v):
    if v is None:
        return "\x00null"
    if isinstance(v, float):
        if math.isnan(v):
            return "\x00null"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _cell(v.item())
    return repr(v)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(_cell(r[i]) for i in order) for r in records)


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update(r.encode("utf-8", "surrogatepass"))
        h.update(b"\n")
    return h.hexdigest()[:16]


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_recs = [tuple(r) for r in df.collect()]
    t1 = time.time()
    out = {"query": name, "spark_rows": len(s_recs), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_recs = res.fetchall()
    out["oracle_rows"] = len(o_recs)
    out["oracle_sec"] = round(time.time() - t1, 2)
    if sorted(s_cols) != sorted(o_cols):
        out["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(o_cols)}"
        return out
    a, b = _rows(s_cols, s_recs), _rows(o_cols, o_recs)
    if digest(a) == digest(b):
        out["status"] = "match"
    else:
        sa, sb = set(a), set(b)
        out["status"] = "MISMATCH"
        out["only_spark"] = [x[:300] for x in sorted(sa - sb)[:3]]
        out["only_oracle"] = [x[:300] for x in sorted(sb - sa)[:3]]
    return out


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    import __spark_entry__ as E
    from aspectra.session import get_session

    spark = get_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(args.sf)
    names = args.names or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], sqls.get(n), args.sf, con)
        except Exception as e:  # report and continue with the next query
            r = {"query": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
