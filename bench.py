"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS], written to the noop sink.

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "rows": {...}, "sf", ...}.
Per query: one warm-up run, then the median of $BENCH_REPEATS timed runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from tokenloom.plans import QUERIES
    from tokenloom.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="tokenloom-bench")
    names = only or sorted(QUERIES)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            def run() -> float:
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                return time.perf_counter() - t0
            run()  # warm-up (also JIT and file listing caches)
            times[name] = round(statistics.median(run() for _ in range(repeats)), 3)
            rows[name] = QUERIES[name](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001 - report and continue with the other queries
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeats": repeats,
        "spark": spark.version,
    }
    if errors:
        out["errors"] = errors
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
