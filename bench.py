"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query
runs to the end over the whole tables; its rows go to Spark's no-op sink. One
untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from retail_insight.plans.queries import QUERIES
from retail_insight.sources.workspace import release

HEADLINE = (
    "daily_sales_ma7",
    "kpis",
    "top_categories_by_count",
    "payment_mix",
    "daily_return_rate",
    "churn_by_gender",
    "age_histogram",
    "monthly_revenue_filled",
    "parse_time_strict",
    "parse_time_prefix",
    "etl_purchases",
    "derive_churn",
    "rfm_dated",
    "rfm_describe",
    "rfm_histogram_monetary",
    "product_profile",
    "cluster_profile_fixed",
    "recommend_all_fixed",
    "customer_segments",
    "product_clusters",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("retail-insight-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", f"/tmp/retail-insight-bench-{os.getpid()}"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds = round(time.perf_counter() - start, 3)
        release(spark)
        return seconds

    run("payment_counts")
    seconds = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
