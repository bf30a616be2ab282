"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores. Every query runs
in full: its result goes to Spark's no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from shelfsense.plans.catalogue import QUERIES
from shelfsense.session import build_session

HEADLINE = [
    "rate_more_products",
    "rate_more_recently",
    "average_products",
    "hot_products_top_n",
    "product_detail",
    "product_search",
    "product_search_indexed",
    "log_route_counts",
    "log_clean_ratings",
    "log_quarantine",
    "recent_ratings",
    "rating_upsert",
    "load_ratings_file",
    "stream_rating_state",
    "stream_late_views",
    "user_hash_id",
    "item_cooccurrence",
    "itemcf_topk",
    "serve_itemcf",
    "content_tfidf",
    "content_similar",
    "content_topk",
    "content_hashed_terms",
    "als_user_recs",
    "als_item_topk",
    "vector_best_dots",
    "realtime_scores",
    "hot_items_window",
    "login_burst",
    "login_pattern",
    "stream_hot_items",
    "stream_login_burst",
    "stream_login_pattern",
    "stream_recs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executor threads, the SQL engine and one Python worker before the clock runs.
    spark.range(1000).groupBy("id").count().write.mode("overwrite").format("noop").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
