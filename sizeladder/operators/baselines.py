"""Models without features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_class(long: DataFrame, cell: list[str]) -> DataFrame:
    """Most frequent training class (lowest label on ties) as the prediction for every row.

    Counting by class first keeps the aggregation free of whole-cell groups.
    """
    counts = long.where("set = 'train'").groupBy(*cell, "y").agg(F.count(F.lit(1)).alias("_c"))
    top = counts.groupBy(*cell).agg(F.max_by("y", F.struct(F.col("_c"), -F.col("y"))).alias("yhat"))
    return long.join(F.broadcast(top), cell)  # one row per cell


def mean_target(long: DataFrame, cell: list[str]) -> DataFrame:
    top = long.where("set = 'train'").groupBy(*cell).agg(F.avg("y").alias("yhat"))
    return long.join(F.broadcast(top), cell)  # one row per cell
