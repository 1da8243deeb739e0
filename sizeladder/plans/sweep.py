"""From samples to scores, curves and extrapolations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curves import statistics
from ..operators.gram import width_of
from ..operators.grids import feasible_grid, grid_points
from ..operators.prepare import feature_mode
from ..operators.select import select_best
from ..operators.splits import Size, make_splits
from ..schema import SAMPLE
from ..session import store
from .incremental import cells_of, missing_points, plan_points, split_points
from .models import MODELS


BROADCAST_IDS = 2_000_000  # split rows sent to the samples (about 100 MB); more are joined by shuffle


def split_rows(sizes: list[Size], seeds: list[int], runs: int = 1) -> int:
    """Upper bound on the rows of the splits, from the configuration alone."""
    return sum(s.total for s in sizes) * len(seeds) * runs


def gather(samples: DataFrame, splits: DataFrame, run: list[str], mode: str = "normal",
           rows: int | None = None) -> DataFrame:
    """Split rows with their model input: (run..., n, seed, sample_id, set, x, y).

    With `rows`, a bound on the split rows, splits within BROADCAST_IDS go to the samples, which then
    stay where they are; larger ones are joined by shuffle.
    """
    picked = feature_mode(samples, mode).select(*run, SAMPLE, "x", F.col("y").cast("double").alias("y"))
    if rows is not None and rows <= BROADCAST_IDS:
        splits = F.broadcast(splits)
    return splits.join(picked, [*run, SAMPLE])


def sweep(long: DataFrame, model: str, grid: dict, run: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Scores (run..., n, s, grid_index, params, metrics) of one model over its grid.

    Points that `existing` already holds are taken from there and not fitted again.
    """
    if model not in MODELS:
        raise ValueError(f"Invalid model type: {model}")
    cell = [*run, "n", "seed"]
    grid = feasible_grid(grid, width_of(long))
    if existing is None:
        return MODELS[model].sweep(long, cell, grid).withColumnRenamed("seed", "s")
    reused, todo = split_points(plan_points(cells_of(long, run), grid), existing, run)
    out = reused
    for missing, cells in missing_points(todo, run):
        fresh = MODELS[model].sweep(long.join(F.broadcast(cells), cell, "left_semi"), cell,
                                    [grid_points(grid)[i] for i in missing])
        place = F.get(F.array(*[F.lit(i) for i in missing]), F.col("grid_index"))
        out = out.unionByName(fresh.withColumn("grid_index", place).withColumnRenamed("seed", "s"), allowMissingColumns=True)
    return out


def learning_curve(samples: DataFrame, sizes: list[Size], seeds: list[int], run: list[str], model: str, grid: dict,
                   method: str = "none", stratify: bool = False, balanced: bool = False,
                   repeats: int = 100, runs: int = 1) -> dict[str, DataFrame]:
    """Every table of a learning curve, from stored samples (run..., sample_id, x, y, [c], valid).

    The gathered rows and the scores are written once: both are small next to the samples, and every
    later step reads them several times.
    """
    splits, status = make_splits(samples, sizes, seeds, run, method, stratify, balanced)
    mode = method if method in ("with-cni", "only-cni") else "normal"
    long = store(gather(samples, splits, run, mode, split_rows(sizes, seeds, runs)), "gathered")
    scores = store(sweep(long, model, grid, run), "scores")
    best = select_best(scores, run)
    metric = "r2_test" if MODELS[model].regression else "acc_test"
    return {"splits": long.select(*run, "n", "seed", SAMPLE, "set"), "status": status, "scores": scores, "best": best,
            **statistics(best, run, metric, repeats)}
