"""Run catalog queries in Spark and their oracle SQL in DuckDB; compare.

Usage: ``python -m tripframe.plans.check [sf_dir] [name ...]``. Exits
non-zero on any mismatch. Comparison is order-insensitive; floats are
compared after rounding to 6 significant digits.
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


EXACT = False


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if abs(v) < 1e-9:
            return 0.0
        if EXACT:
            return v
        return float(f"{v:.6g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(f"{float(v):.6g}") if abs(v) > 2 ** 53 else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return cols, sorted(out, key=key)


def compare(spark_pdf, oracle_pdf) -> str | None:
    sc, sr = _rows(spark_pdf)
    oc, orows = _rows(oracle_pdf)
    if sc != oc:
        return f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orows):
        return f"row count spark={len(sr)} oracle={len(orows)}"
    for a, b in zip(sr, orows):
        if a != b:
            return f"first differing row:\n  spark ={a}\n  oracle={b}"
    return None


def main(argv):
    global EXACT
    if "--exact" in argv:
        EXACT = True
        argv = [a for a in argv if a != "--exact"]
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import duckdb

    from tripframe.plans import load_all
    from tripframe.plans.doubles import DOUBLE_COLUMNS
    from tripframe.plans.registry import round_doubles, round_sql
    from tripframe.session import get_spark
    raw_q, raw_o = load_all()
    queries = {n: (lambda f: lambda s, d: round_doubles(f(s, d)))(f) for n, f in raw_q.items()}
    oracle = {n: round_sql(sql, DOUBLE_COLUMNS.get(n, ())) for n, sql in raw_o.items()}
    spark = get_spark("local[8]", extra={"spark.sql.shuffle.partitions": "8"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            spdf = queries[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in oracle:
            print(f"ROWS {name}: {len(spdf)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            opdf = con.sql(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(spdf, opdf)
        if msg:
            bad += 1
            print(f"FAIL {name}: {msg}")
        else:
            print(f"OK   {name}: {len(spdf)} rows {dt:.1f}s")
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
