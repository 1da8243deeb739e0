"""Hyperparameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feasible_grid(grid: dict, width: int) -> dict:
    """A grid with values that cannot be reached replaced by the largest that can, each once.

    There are at most `width` components or selected features. Scores carry the values that were used.
    """
    limits = {"pca__n_components": width, "rfe__n_features_to_select": width}
    return {k: sorted({min(v, limits[k]) for v in values}) if k in limits else values for k, values in grid.items()}


def grid_points(grid: dict | list[dict]) -> list[dict]:
    """All combinations of a model's grid: names sorted, the last one varies fastest; {} is one point.

    A list of points is taken as it is.
    """
    if isinstance(grid, list):
        return grid
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]


def expand_grid(grids: DataFrame, key: list[str]) -> DataFrame:
    """(key..., params MAP<STRING, ARRAY<DOUBLE>>) to one row per combination.

    Output: (key..., grid_index, params MAP<STRING,DOUBLE>), in the order of :func:`grid_points`.
    """
    names = F.array_sort(F.map_keys("params"))
    start = F.array(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))

    def cross(points: Column, name: Column) -> Column:
        values = F.col("params")[name]
        return F.flatten(F.transform(points, lambda p: F.transform(
            values, lambda v: F.map_concat(p, F.map_from_arrays(F.array(name), F.array(v))))))

    points = F.aggregate(names, start, cross)
    return grids.select(*key, F.posexplode(points).alias("grid_index", "params"))


def route_parameters(params: Column, step: str) -> Column:
    """Parameters of one pipeline step: names that start with `step__`, without that prefix."""
    prefix = f"{step}__"
    chosen = F.map_filter(params, lambda k, _: k.startswith(prefix))
    return F.transform_keys(chosen, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def first_match(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row per key in an explicit order."""
    return (df.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
            .where("_p = 1").drop("_p"))


def params_key(params: Column) -> Column:
    """Canonical text of a parameter map, usable as a join key."""
    return F.concat_ws(";", F.transform(F.array_sort(F.map_entries(params)),
                                        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
