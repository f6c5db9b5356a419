"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waveplan.plans.catalog import QUERIES  # noqa: E402
from waveplan.session import build_session  # noqa: E402

HEADLINE = [
    "wave_summary",
    "wave_summary_scenarios",
    "export_assigned",
    "scenario_sweep",
    "scenario_best",
    "carton_running",
    "carton_running_scaled",
    "distro_locations",
    "dpci_locations",
    "dpci_first_distro",
    "pallet_waves",
    "accepted_rows",
]
RUNS = 3


def measure(spark, name: str, folder: str) -> float:
    """Seconds to build the plan and produce every row."""
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cores}]", cores)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        measure(spark, name, folder)
        times[name] = round(statistics.median(measure(spark, name, folder) for _ in range(RUNS)), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
