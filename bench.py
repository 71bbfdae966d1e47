"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query is written to a noop sink; the better of two runs counts."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("numeric_statistics", "categorical_topk", "datetime_statistics", "correlation_long", "null_profile", "uniqueness", "numeric_parse_rate", "iqr_outliers_raw", "semantic_types", "conversion_audit_numeric", "before_after_diff", "iqr_filter", "legacy_percentage", "pipeline_log")


def main() -> None:
    from pyspark.sql import SparkSession

    from tabulens.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(min(took), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
