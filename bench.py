"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cleargrain.plans import catalog
from cleargrain.session import local_session

HEADLINE = [
    "clean_rules", "std_category", "check_business", "check_duplicates", "classify_anomalies", "tag_frequency",
    "describe_numeric", "repair_total", "dedupe_order_id", "repair_pipeline", "features_train", "isolation_forest", "roc_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), spark__ui__showConsoleProgress="false")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows,
                "classify_rows_per_second": round(rows / seconds["classify_anomalies"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
