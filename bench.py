"""Time headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of local cores,
``BENCH_QUERIES`` a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import time

from storegrain.catalog import load_all
from storegrain.session import build_session, drop_staged

HEADLINE = [
    "survival_stats", "category_stats", "stats_cube", "stats_rollup_region", "cross_profile", "top_subcategories",
    "map_api_columns", "dedupe_rows", "impute_median", "iqr_outliers", "clean_all", "label_all", "features_all",
    "encode_label", "scale_standard", "scale_robust", "dedupe_latest", "join_status", "merge_population", "upsert_stores",
    "retain_runs", "run_state", "split_assign_exact", "metrics_auc", "metrics_regression", "competitors_in_radius",
    "stores_in_radius", "store_documents", "cosine_topk", "last_turns", "collection_windows", "scan_store_pages",
    "stream_upsert", "train_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, times, failed = load_all(), {}, {}
    registry["store_count"].run(spark, folder).collect()  # starts the session, not timed
    for name in names:
        start = time.perf_counter()
        try:
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a failed query is reported, not hidden
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
    result = {
        "metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    if failed:
        result["failed"] = failed
    drop_staged(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
