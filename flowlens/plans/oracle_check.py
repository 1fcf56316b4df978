"""Local twin of the driver's correctness gate: run a registered query in Spark and
its SQL in DuckDB on the same parquet tables and compare row count, column names
and an order-insensitive value hash (plus a tolerant value diff for diagnosis).

Usage: python -m flowlens.plans.oracle_check [sf_dir] [name ...]
"""
from __future__ import annotations

import hashlib
import math
import sys
import time

from .tables import TABLES


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 9)
    except Exception:  # noqa: BLE001
        pass
    return v


def _rows(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(None if (not isinstance(x, (list, tuple)) and not hasattr(x, "__len__") and pd.isna(x))
                               else x) for x in rec))
    return cols, out


def _key(row):
    return tuple((0, "") if x is None else (1, repr(x)) for x in row)


def compare(sdf, ddf) -> dict:
    scols, srows = _rows(sdf)
    dcols, drows = _rows(ddf)
    res = {"spark_rows": len(srows), "oracle_rows": len(drows), "columns_match": scols == dcols}
    srows.sort(key=_key)
    drows.sort(key=_key)
    hs = hashlib.sha256(repr(srows).encode()).hexdigest()
    hd = hashlib.sha256(repr(drows).encode()).hexdigest()
    res["hash_match"] = hs == hd
    if not res["hash_match"] and res["columns_match"] and len(srows) == len(drows):
        diffs = []
        for a, b in zip(srows, drows):
            for c, x, y in zip(scols, a, b):
                if isinstance(x, float) and isinstance(y, float):
                    if not math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9):
                        diffs.append((c, x, y))
                elif x != y:
                    diffs.append((c, x, y))
        res["diffs"] = diffs[:5]
        res["n_diffs"] = len(diffs)
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = scols, dcols
    return res


def main(argv):
    from ..session import local_session
    from .all import ORACLE, QUERIES
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if n not in ORACLE:
            print(f"ROWS {n}: {len(sdf)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            ddf = con.execute(ORACLE[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        res = compare(sdf, ddf)
        ok = res["hash_match"] and res["columns_match"] and res["spark_rows"] == res["oracle_rows"]
        bad += 0 if ok else 1
        print(f"{'OK  ' if ok else 'FAIL'} {n}: {res} {t1 - t0:.1f}s")
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
