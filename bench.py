"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w03_seeded_permutation",       # exact distributed ranks, whole table
    "w04_split_assign",             # all sizes x seeds at once
    "w05_stratified_split",
    "w06_class_balancing",
    "w02_quantile_transform",
    "j04_matched_neighbours",       # covariate matching
    "m19_confound_regression",
    "m20_grid_sweep",               # default ridge grid: 25 cells x 11 points
    "m05_ridge_classifier_ten_classes",
    "m11_pca_ridge_classifier",
    "m21_model_selection",
    "m22_power_law",
    "m23_bootstrap_fits",
    "m08_random_forest_regressor",
    "m09_boosting_classifier",
    "m13_rfe_ridge_classifier",
    "m18_poly_svm_regressor",
    "j04_matched_two_covariates",
    "e01_learning_curve",
    "e02_run_experiments",
]


def main() -> None:
    from sizeladder.queries import QUERIES, load_all
    from sizeladder.session import local_session
    load_all()
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the engine
    spark.range(8).mapInPandas(lambda it: it, "id long").collect()                         # and the workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
