"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores. The scan of the
given tables and their turning into tracking data is the entry ``land_views``; the
other entries read what it wrote.
"""

from __future__ import annotations

import json
import os
import time

from checks import views
from checks.catalog import QUERIES
from checks.compare import session
from trackuse.sources.staging import cleanup

HEADLINE = [
    "import_locations",
    "clean_locations",
    "rolling_outliers",
    "neighbour_count",
    "dbscan",
    "dbscan_250m",
    "site_median",
    "presence_days",
    "peak_window",
    "site_use_by_year",
    "site_summary",
    "clustered_site_summary",
    "recent_site_summary",
    "seasonal_profile",
    "occupancy_roll14",
    "tag_effort",
    "routes",
    "points_in_region",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    start = time.perf_counter()
    for view in (views.fixes, views.raw_fixes, views.deployments, views.event_fixes, views.order_fixes):
        view(spark, sf).write.format("noop").mode("overwrite").save()
    seconds["land_views"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf,
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
            }
        )
    )
    cleanup(spark)
    spark.stop()


if __name__ == "__main__":
    main()
