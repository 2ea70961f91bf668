"""Benchmark: wall seconds per registered query at one scale factor.

Runs every ``queries()`` entry on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``. Each query is built and fully executed (``noop`` write, so row-level results are
computed without moving them to the driver). A few small queries on ``sf0.001`` warm the session up, untimed. After every query the state so far is printed as
ONE JSON line, ``{"metric": ..., "value": total_seconds, "unit": "sec", "queries": {...}, "sf": ...}``; the last line is the result. Model sweeps
run last. Queries that had not begun after ``$BENCH_BUDGET`` seconds (default 1,500) are listed under ``not_run``, with whole figures for the others.
``BENCH_QUERIES`` (comma list) restricts the set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from tabulyst.plans.registry import queries
    from tabulyst.session import checkpoint_dir, local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="tabulyst-bench")
    checkpoint_dir(spark)
    qs = queries()
    late = ("model_", "feature_importance", "automl_")  # longest last
    names = only or sorted(qs, key=lambda q: next((i for i, p in enumerate(late, 1) if q.startswith(p)), 0))
    budget, began = float(os.environ.get("BENCH_BUDGET", "1500")), time.perf_counter()
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm_dir) and os.environ.get("BENCH_WARMUP", "1") == "1":
        for name in [q for q in ("profile_statistics", "duplicate_summary", "kendall_pairs", "forecast_split") if q in qs]:
            qs[name](spark, warm_dir).write.mode("overwrite").format("noop").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    m = re.search(r"sf([0-9.]+)", sf_dir)

    def state(left: list[str]) -> None:
        out = {"metric": "sum_query_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
               "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "n_queries": len(times)}
        print(json.dumps(out | ({"failed": failed} if failed else {}) | ({"not_run": left} if left else {})), flush=True)

    for i, name in enumerate(names):
        if time.perf_counter() - began > budget:
            break
        t0 = time.perf_counter()
        try:
            df = qs[name](spark, sf_dir)
            df.write.mode("overwrite").format("noop").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - report and continue
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
        # outside the timed region: drop caches and collect garbage so that one
        # query's leftovers do not slow the next one in this long-lived local JVM
        spark.catalog.clearCache()
        spark.sparkContext._jvm.System.gc()
        state(names[i + 1:])
    spark.stop()


if __name__ == "__main__":
    main()
