"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` (comma-separated) a different choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from terrafold.plans import catalog  # noqa: E402
from terrafold.session import use_local_folder  # noqa: E402

HEADLINE = [
    "ingest_climatology", "sample_grid_at_points", "depth_weighted_mean", "stratified_sample",
    "write_model_ready", "median_impute", "group_kfold", "mean_baseline_cv", "mean_baseline_summary",
    "metrics_by_model_category", "metrics_all_levels", "error_by_observed_bin", "mae_by_reference_bin",
    "histogram_minmax", "boxplot_stats", "corr_with_target", "sample_exact_n", "sample_per_group",
    "random_split", "quantile_bins", "exact_quantiles", "paired_tests", "contribution_by_category",
    "random_forest_cv", "boosted_trees_cv", "feature_importance", "tree_contributions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("terrafold-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM before timing
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
