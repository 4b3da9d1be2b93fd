"""Time the headline queries: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.

Every result is written whole to the noop sink. Each query runs ``BENCH_RUNS`` times (default 3)
and its best time counts, so that class loading and code generation of the first run do not.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gleanframe.session import local_session
from suite import all_queries

HEADLINE = (
    "filter_conjunction",
    "filter_contains",
    "page_sorted_desc",
    "page_next_desc",
    "page_counts",
    "page_jump_far_number",
    "query_pricing_summary",
    "query_global_aggregate",
    "query_having",
    "query_distinct",
    "overview_lineitem",
    "sparkline_numbers",
    "sparkline_text",
    "suggest_matching_text",
    "profile_universal_price",
    "profile_numeric_price",
    "profile_numeric_rank_select",
    "profile_histogram_price",
    "profile_tail_values",
    "profile_string_documents",
    "profile_pattern_urls",
    "profile_dates_shipped",
    "profile_whole_numeric",
    "profile_whole_string",
    "compare_two_tables",
    "sql_inner_join",
    "csv_export_and_scan_texts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = all_queries(), {}
    for name in chosen:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
