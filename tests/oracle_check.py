"""Run registered queries against their DuckDB statements the way the driver does.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from linkwork.session import get_spark

    spark = get_spark("oracle-check")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf)
        rows = [tuple(r) for r in df.collect()]
        el = time.time() - t0
        cols = df.columns
        if name not in sql:
            print(f"{name:28s} rows={len(rows):6d} spark={el:6.2f}s  (no oracle)", flush=True)
            continue
        rel = con.sql(sql[name])
        ocols, orows = rel.columns, rel.fetchall()
        ok = sorted(cols) == sorted(ocols) and len(rows) == len(orows) and digest(cols, rows) == digest(ocols, orows)
        st = dict(df.dtypes)
        ot = {c: str(t) for c, t in zip(ocols, rel.types)}
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        tbad = [(c, st[c], ot.get(c)) for c in cols if tmap.get(st[c], st[c]) != ot.get(c)]
        if tbad:
            print("   type differences:", tbad)
        bad += not ok
        print(f"{name:28s} rows={len(rows):6d}/{len(orows):6d} spark={el:6.2f}s {'OK' if ok else 'MISMATCH'}"
              + ("" if sorted(cols) == sorted(ocols) else f" cols {cols} vs {ocols}"), flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
