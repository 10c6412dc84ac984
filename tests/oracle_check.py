"""Spark-vs-DuckDB comparison, as the driver does it (row count, column names,
order-insensitive values).  Usable from pytest and as a script:

    python tests/oracle_check.py [--strict] [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False  # --strict: compare exact float bits (signed zero included)


def _norm(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    ts = time.time() - t
    if sql is None:
        return {"name": name, "ok": None, "rows": len(sp), "spark_s": ts}
    dk = con.execute(sql).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    res = {"name": name, "rows": len(sp), "oracle_rows": len(dk), "spark_s": round(ts, 2),
           "cols_ok": sc == dc, "rows_ok": len(sr) == len(dr)}
    res["values_ok"] = res["cols_ok"] and sr == dr
    res["ok"] = res["cols_ok"] and res["rows_ok"] and res["values_ok"]
    if not res["ok"]:
        res["spark_cols"], res["oracle_cols"] = sc, dc
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        res["first_diffs"] = diff
    sdt = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    res["dtypes"] = {c: (sdt.get(c), str(dk[c].dtype) if c in dk else None) for c in sc}
    res["dtype_mismatch"] = {c: (str(sp[c].dtype), str(dk[c].dtype)) for c in sc
                             if c in dk and c in sp and str(sp[c].dtype) != str(dk[c].dtype)}
    return res


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from listenlens.session import get_session
    import __spark_entry__ as E

    args = [a for a in sys.argv[1:] if a != "--strict"]
    STRICT = "--strict" in sys.argv
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, con, n, qs[n], orc.get(n), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "error": repr(e)[:2000]}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
