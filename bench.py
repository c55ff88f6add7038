"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_RUNS
(timed runs per query after one warm-up; the median counts), BENCH_QUERIES
(comma-separated names instead of the headline set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from vitrine.queries.registry import entries
from vitrine.session import build_session

HEADLINE = (
    "trending_frequency",
    "trending_quality",
    "trending_all_queries",
    "click_attribution",
    "trending_tick_rows",
    "vector_top_k",
    "vector_top_k_filtered",
    "vector_top_k_blocks",
    "search_with_count",
    "radius_count",
    "nearest_to_id",
    "rank_fusion",
    "personal_rails",
    "all_neighbours_exact",
    "all_neighbours_probed",
    "text_search",
    "lexical_products",
    "lexical_documents",
    "similar_items",
    "facet_snapshot",
    "drop_membership",
    "shipments_by_drop",
    "browse_first_pages",
    "batch_fetch",
    "stage_counts",
    "recent_views",
    "recent_searches",
    "product_normalisation",
    "staged_chunks",
    "keyed_upsert",
    "valid_row_slices",
    "blob_budget",
    "backfill_applied",
    "embedded_catalog",
    "stream_sliding_counts",
    "stream_stage_ledger",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "vitrine-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            entries()[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(f"{name}: cold {taken[0]:.2f} warm {seconds[name]:.2f}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
