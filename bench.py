"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables, default ``/root/testdata/sf0.1``) and ``BENCH_CPUS``
(default 8).  Every query is run in full and its rows are discarded at the sink.  The first
query is run once beforehand, so that JVM and worker start-up is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfgrain.plans.registry import QUERIES, flagship  # noqa: E402
from shelfgrain.session import build_session  # noqa: E402

HEADLINES = (
    "page_facts", "page_names", "page_links", "dedup_by_name", "products_full", "products_lean",
    "product_links_full", "product_lookup", "price_resolved", "product_ids", "sheet", "summary_rows",
    "page_yields", "fetch_join", "fetch_failures", "stop_after_empty", "rolling_response",
    "error_pressure", "health_signal", "within_budget_share", "run_stats",
    "site_catalog", "full_catalog", "lean_catalog", "stream_products", "stream_stats",
)


def run(name: str, query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]", cpus,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run("flagship", flagship, spark, folder)
    times = {"flagship": run("flagship", flagship, spark, folder)}
    for name in HEADLINES:
        times[name] = run(name, QUERIES[name], spark, folder)
    products = QUERIES["full_catalog"](spark, folder).count()
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(os.path.basename(folder).removeprefix("sf")),
        "full_catalog_products_per_sec": round(products / times["full_catalog"], 1),
    }))


if __name__ == "__main__":
    main()
