"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_MEMORY`` the driver's memory.
"""

import json
import os
import time

from triagework.plans.query_set import QUERIES
from triagework.session import build_session

HEADLINES = [
    "scan_tickets", "clean_text", "text_stats_strict", "resolution_ranges", "resolution_lookup", "stats_by_priority",
    "triage_batch", "route_append", "queue_numbers", "batch_kpis", "priority_by_department", "stratified_split",
    "target_encode", "vocab_topk", "tfidf_long", "preprocess_job", "classification_report", "train_logreg", "train_svm",
    "train_boosted", "train_cat_boosted", "train_ridge", "train_forest", "score_batch", "stream_routing",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
