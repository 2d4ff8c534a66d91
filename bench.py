"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w1_relevance_search",
    "f2_filter_main_catalog",
    "a1_duplicate_products",
    "a2_duplicate_groups",
    "a7_facet_meta",
    "a13_stock_by_barcode",
    "j1_match_stock_to_catalog",
    "j4_link_categories",
    "j5_price_cart",
    "w2_best_record_dedup",
    "w11_user_history_page",
    "u1_upsert_source",
    "u12_fold_cart_events",
    "m8_normalize_client_item",
    "p1_extract_products",
    "p11_page_links",
    "c2_norm_code_unicode",
    "x5_stream_view_counts",
]


def main() -> None:
    from shelfspark.plans import QUERIES
    from shelfspark.session import clear_written, local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/part.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every row and column is computed, nothing is sent to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_written(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
