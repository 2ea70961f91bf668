"""Run registered queries in Spark and their SQL oracles in DuckDB; compare results.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and values (rows sorted, floats to 6 places).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabulyst.plans.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
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
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except Exception:  # noqa: BLE001
        pass
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(name, spark_pdf, duck_pdf):
    c1, r1 = rows_of(spark_pdf)
    c2, r2 = rows_of(duck_pdf)
    if c1 != c2:
        return f"COLUMNS {c1} vs {c2}"
    if len(r1) != len(r2):
        return f"ROWS {len(r1)} vs {len(r2)}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"VALUES {len(bad)} differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    return "ok"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from tabulyst.plans.registry import oracle_sql, queries
    from tabulyst.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    names = names or list(qs)
    summary = {}
    for n in names:
        t0 = time.time()
        try:
            sp = qs[n](spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            summary[n] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(n, summary[n], flush=True)
            continue
        dt = time.time() - t0
        if n not in os_:
            summary[n] = f"rows-only ({len(sp)} rows)"
        else:
            try:
                dk = con.execute(os_[n]).df()
                summary[n] = compare(n, sp, dk)
            except Exception as exc:  # noqa: BLE001
                summary[n] = f"ORACLE ERROR {type(exc).__name__}: {str(exc)[:300]}"
        print(f"{n:32s} {dt:6.2f}s  {summary[n]}", flush=True)
    bad = [n for n, v in summary.items() if not (v == "ok" or v.startswith("rows-only"))]
    print(f"\n{len(summary) - len(bad)}/{len(summary)} ok; failing: {bad}")


if __name__ == "__main__":
    main()
