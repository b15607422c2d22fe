"""Time headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "qa8_true_steady_sellers",
    "qa6_rating_quadrants",
    "qa9_viral_products",
    "pf6_value_index",
    "rf6_user_activity",
    "rf9_repurchase_flags",
    "rf14_promo_match",
    "ag12_product_summary",
    "ag17_two_metric_outliers",
    "qa15_mann_whitney",
    "ts3_monthly_category_2",
    "ts10_calendar_counts",
    "dq1_dedup_texts",
    "dq11_copied_texts",
    "dim3_order_ids",
    "io4_upsert",
    "tx3_keyword_frequency",
    "tx6_tfidf",
    "tx11_category_frequency",
    "lb4_stratified_sample",
    "lb5_balanced_sample",
    "lb10_label_rows",
    "ig8_dedup_items",
    "ig14_correct_names",
    "ig16_merge_sources",
    "ig19_product_verdicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "")
    from loomshelf import catalog
    from loomshelf.session import local_session

    spark = local_session(cores, shuffle_partitions=cores)
    wanted = list(catalog.QUERIES) if names == "all" else [n for n in names.split(",") if n] or HEADLINE
    # times are for a warm session: compile and page in once, with a query that is not in the list
    next((q for n, q in catalog.QUERIES.items() if n not in HEADLINE))(spark, sf_dir).collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - one bad query must not hide the others' times
            print(f"FAILED {name}: {str(e)[:500]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
