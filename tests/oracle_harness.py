"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Compares column names, row counts and the multiset of rows (floats rounded).
Usable from pytest and as a script: python tests/oracle_harness.py SF_DIR [names..]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_EXACT") else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(v) if os.environ.get("ORACLE_EXACT") else round(float(v), 6)
    except Exception:
        pass
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def _spark_type(t) -> str:
    return t.simpleString().upper()


_EQUIV = {"BIGINT": {"BIGINT", "INT64"}, "INT": {"INTEGER", "INT32"}, "DOUBLE": {"DOUBLE", "FLOAT64"},
          "STRING": {"VARCHAR", "STRING"}, "BOOLEAN": {"BOOLEAN", "BOOL"}, "DATE": {"DATE"},
          "FLOAT": {"FLOAT"}}


def _same_type(spark_t: str, duck_t: str) -> bool:
    if spark_t in _EQUIV:
        return duck_t in _EQUIV[spark_t]
    if spark_t.startswith("ARRAY<") and duck_t.endswith("[]"):
        return True
    return spark_t == duck_t


def compare(spark, sf_dir, name, fn, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "duck_sec": round(t2 - t1, 2)}
    s_types = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    d_types = {d[0]: str(d[1]).upper() for d in rel.description}
    mism = {c: (s_types[c], d_types.get(c)) for c in s_types
            if d_types.get(c) is not None and not _same_type(s_types[c], d_types[c])}
    if mism:
        res["type_mismatch"] = mism
    if sorted(s_cols) != sorted(d_cols):
        res["error"] = f"columns differ: spark={s_cols} duck={d_cols}"
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["match"] = a == b
    if not res["match"]:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["error"] = f"spark-only={diff_a} duck-only={diff_b}"
    return res


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from riskloom.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", 8, driver_memory="12g")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print({"name": name, "rows_only": n, "sec": round(time.time() - t0, 2)}, flush=True)
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # report and continue
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += not r.get("match")
        print(r, flush=True)
    print("FAILED" if bad else "ALL MATCH", bad)


if __name__ == "__main__":
    main()
