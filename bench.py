"""Run the registered queries at ``$BENCH_SF_DIR`` and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import sys
import time

from artifactlake.registry import QUERIES, load_all
from artifactlake.session import local_session


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = [n for n in QUERIES if not chosen or n in chosen.split(",")]
    # start the executors and the file listing before the clock
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        began = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        print(f"{name} {times.get(name, 'failed')}", file=sys.stderr, flush=True)
    out = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
