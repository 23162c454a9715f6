"""Benchmark: every registered job over the estate tables at one scale factor.

Environment: ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8),
``BENCH_KEYS`` (optional comma list).  The estate tables are derived from the provided
Parquet once and written as Parquet (bills partitioned by period) under the session's
checkpoint folder — the shape the tables have at rest in production; that step is timed
as ``derive_estate``.  Each job then runs once as a warm-up (dropped) and ``BENCH_REPEATS``
(default 3) more times, writing to Spark's ``noop`` sink so every row and column is computed;
the median is reported.  Prints ONE JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearth import registry  # noqa: E402
from hearth.session import build_session, ensure_checkpoint_dir  # noqa: E402
from hearth.sources.parquet import load_estate, read_estate, write_estate  # noqa: E402


REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus,
                          extra={"spark.driver.memory": "16g"})
    base = ensure_checkpoint_dir(spark).rstrip("/")
    root = f"{base}/bench-estate-{uuid.uuid4().hex[:8]}"

    t0 = time.time()
    write_estate(load_estate(spark, sf_dir), root)
    derive = time.time() - t0
    t = read_estate(spark, root)

    jobs = registry.jobs()
    names = keys or list(jobs)
    for k in names:                       # warm-up pass (dropped)
        run(jobs[k](t))
    samples: dict[str, list[float]] = {k: [] for k in names}
    for _ in range(REPEATS):              # whole passes, so a slow moment hits every job alike
        for k in names:
            s = time.time()
            run(jobs[k](t))
            samples[k].append(time.time() - s)
    times = {k: round(statistics.median(v), 3) for k, v in samples.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_job_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "derive_estate_sec": round(derive, 3), "cpus": cpus, "jobs": len(times),
    }, ensure_ascii=False))
    spark.stop()


if __name__ == "__main__":
    main()
