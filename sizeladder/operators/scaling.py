"""Scalers fitted on the training rows of each cell (population spread; zero spread counts as 1)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import standardise


def feature_statistics(long: DataFrame, cell: list[str], x: str = "x") -> DataFrame:
    """(cell..., mean ARRAY, sd ARRAY) over the rows with set = train.

    One vector aggregate per cell with partial sums on the map side; its sample variance is turned
    into the population one.
    """
    stats = (long.where("set = 'train'").groupBy(*cell)
             .agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(x)).alias("_s")))
    n = F.col("_s.count").cast("double")
    spread = F.transform(vector_to_array("_s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return stats.select(*cell, vector_to_array("_s.mean").alias("mean"), spread.alias("sd"))


def target_statistics(long: DataFrame, cell: list[str], y: str = "y") -> DataFrame:
    sd = F.stddev_pop(y)
    return (long.where("set = 'train'").groupBy(*cell)
            .agg(F.avg(y).alias("y_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("y_sd")))


BROADCAST_VALUES = 5_000_000  # numbers of scaler statistics sent to every task (80 MB for mean and spread)


def scale_features(long: DataFrame, cell: list[str], x: str = "x", values: int | None = None) -> DataFrame:
    """Standardised inputs. `values` is cells x features where known; within the bound the statistics are
    broadcast, otherwise the join is left to the optimiser."""
    stats = feature_statistics(long, cell, x)
    if values is not None and values <= BROADCAST_VALUES:
        stats = F.broadcast(stats)
    return long.join(stats, cell).withColumn(x, standardise(F.col(x), F.col("mean"), F.col("sd"))).drop("mean", "sd")


def scale_targets(long: DataFrame, cell: list[str], y: str = "y", out: str = "y_scaled") -> DataFrame:
    stats = F.broadcast(target_statistics(long, cell, y))  # one row per cell
    return long.join(stats, cell).withColumn(out, (F.col(y) - F.col("y_mean")) / F.col("y_sd"))


def unscale_predictions(pred: DataFrame, yhat: str = "yhat") -> DataFrame:
    return pred.withColumn(yhat, F.col(yhat) * F.col("y_sd") + F.col("y_mean")).drop("y_mean", "y_sd")
