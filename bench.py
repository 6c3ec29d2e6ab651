"""Times the headline queries: one JSON line, median of warm runs per query.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the tables, the cores and the warm runs.
"""

import json
import os
import statistics
import sys
import time

from boxoffice.plans.catalog import QUERIES
from boxoffice.session import local_session

HEADLINE = (
    "top_listings", "platform_kpis", "monthly_summary", "revenue_by_type", "top_creators", "city_breakdown", "creator_summary",
    "creator_performance", "creator_trend", "user_summary", "user_spend_6m", "user_type_history", "recommendations", "catalogue_search",
    "similar_listings", "batch_search", "registration_search", "attendee_list", "ticket_detail", "admission", "settlement",
    "checkin_verdicts", "waitlist_promotion", "publish_fanout", "inbox", "integrity_audit", "stream_daily_views", "stream_first_scans",
)


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "boxoffice-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, folder)  # warm-up
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "warm_runs": runs}))


if __name__ == "__main__":
    main()
