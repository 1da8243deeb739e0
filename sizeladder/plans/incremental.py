"""Reuse of stored scores: only missing (run, n, seed, hyperparameters) are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.grids import grid_points, params_key
from ..session import store


def with_params_key(scores: DataFrame) -> DataFrame:
    return scores.withColumn("_point", params_key(F.col("params")))


def first_scores(existing: DataFrame, run: list[str]) -> DataFrame:
    """One stored row per (run, n, s, hyperparameters): the first by grid position."""
    w = Window.partitionBy(*run, "n", "s", "_point").orderBy("grid_index")
    return (with_params_key(existing).withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p"))


def plan_points(cells: DataFrame, grid: dict) -> DataFrame:
    """Cells (run..., n, s) x grid points; the grid is a literal."""
    points = F.array(*[F.struct(F.lit(i).alias("grid_index"), F.map_from_arrays(
        F.array(*[F.lit(k) for k in p]).cast("array<string>"),
        F.array(*[F.lit(float(v)) for v in p.values()]).cast("array<double>")).alias("params"))
        for i, p in enumerate(grid_points(grid))])
    return with_params_key(cells.select("*", F.inline(points)))


def split_points(points: DataFrame, existing: DataFrame, run: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored scores of the wanted points, points still to be computed)."""
    key = [*run, "n", "s", "_point"]
    stored = first_scores(existing, run)
    reused = points.join(stored.drop("grid_index", "params"), key).drop("_point")
    return reused, points.join(stored, key, "left_anti").drop("_point")


def cells_of(long: DataFrame, run: list[str]) -> DataFrame:
    return long.select(*run, "n", F.col("seed").alias("s")).distinct()


def missing_points(todo: DataFrame, run: list[str]) -> list[tuple[list[int], DataFrame]]:
    """(grid positions, cells (run..., n, seed)) for every set of points that some cells lack.

    Cells with the same gaps are fitted together. There are as many sets as ways in which earlier runs stopped, and
    never more than cells in the configuration.
    """
    gaps = todo.groupBy(*run, "n", "s").agg(F.array_sort(F.collect_list("grid_index")).alias("_missing"))
    gaps = store(gaps, "gaps")
    return [(list(r["_missing"]), gaps.where(F.col("_missing") == F.array(*[F.lit(i) for i in r["_missing"]]))
             .select(*run, "n", F.col("s").alias("seed")))
            for r in gaps.select("_missing").distinct().collect()]
