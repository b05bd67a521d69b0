"""Headline queries on the bench data; prints one JSON line.

Each query writes its whole result to Spark's no-op sink. The first run of a query compiles its
code and is not counted; the value is the best of the runs that follow.
"""

from __future__ import annotations

import json
import os
import time

from tremorlake.checks.catalog import CHECKS
from tremorlake.session import build_session

HEADLINE = (
    "quake_unify",
    "quake_clean",
    "quake_clean_gaps_kept",
    "region_daily_stats",
    "region_daily_stats_many_boxes",
    "region_enrich_left",
    "cluster_first_match",
    "cluster_first_match_many",
    "cluster_daily_stats",
    "cluster_dim_centres",
    "batch_enrich",
    "serving_filter",
    "kmeans_fact_totals",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tremorlake-bench",
        master=f"local[{cpus}]",
        settings={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            started = time.perf_counter()
            CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
