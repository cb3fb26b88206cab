"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pavelens.queries import QUERIES
from pavelens.session import build_session

HEADLINE = [
    "manifest_report", "select_gps", "gps_health", "arc_length", "sample_by_distance", "pchip_resample",
    "repeat_pass_candidates", "bev_grid", "confusion_matrix", "depth_metrics", "batch_summary", "area_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM and its workers
    took = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
