"""Best hyperparameters per (run, n, s)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null


def union_scores(frames: list[DataFrame]) -> DataFrame:
    """Stack score tables whose columns differ; absent ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def validation_metric(columns: list[str]) -> str | None:
    """r2_val where present, else acc_val, else none."""
    return next((m for m in ("r2_val", "acc_val") if m in columns), None)


def test_metric(columns: list[str]) -> str:
    return "r2_test" if "r2_test" in columns else "acc_test"


def select_best(scores: DataFrame, run: list[str], order: list[str] | None = None) -> DataFrame | None:
    """The row with the highest validation metric per (run..., n, s); the first one on ties.

    A group holds one row per grid point, so it is bounded by the grid. Missing and NaN metrics never
    win; a group with nothing else has no result. None without `n`, `s` or a validation metric.
    """
    metric = validation_metric(scores.columns)
    if metric is None or not {"n", "s"} <= set(scores.columns):
        return None
    value = nan_to_null(F.col(metric).cast("double"))
    w = Window.partitionBy(*run, "n", "s").orderBy(F.col("_v").desc(), *(order or ["grid_index"]))
    return (scores.withColumn("_v", value).where(F.col("_v").isNotNull())
            .withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p", "_v"))


def complete_columns(best: DataFrame) -> DataFrame:
    """Keep the columns without any missing value; one aggregate over a table of one row per (n, s)."""
    kinds = {f.name: f.dataType.simpleString() for f in best.schema.fields}

    def missing(c):
        gap = F.col(c).isNull()
        return gap | F.isnan(c) if kinds[c] in ("double", "float") else gap

    gaps = best.agg(*[F.count_if(missing(c)).alias(c) for c in best.columns]).first()
    return best.select(*[c for c in best.columns if not gaps[c]])
