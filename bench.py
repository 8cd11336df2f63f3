"""Headline queries at one scale: one warm-up, then the median of three timed runs each.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose tables and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from heliofleet.plans.registry import REGISTERED
from heliofleet.session import local_session

HEADLINE = (
    "facility_performance", "fleet_summary", "nearest_weather", "underperformers_by_interval",
    "upsert_readings", "scada_from_reports", "keyword_index_postings", "bm25_top20", "cosine_top20",
    "search_hybrid", "chunk_documents", "route_questions", "metric_rollups", "mask_secrets",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "heliofleet-bench")
    times, rates = {}, {}
    for name in HEADLINE:
        build, _ = REGISTERED[name]
        taken = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:]), 3)
    for name, table in (("facility_performance", "events"), ("nearest_weather", "events"), ("upsert_readings", "events"),
                        ("scada_from_reports", "events"), ("keyword_index_postings", "documents"), ("bm25_top20", "benchmark"),
                        ("route_questions", "orders"), ("mask_secrets", "documents")):
        rates[name] = round(spark.read.parquet(f"{sf_dir}/{table}.parquet").count() / times[name], 1)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "input_rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
