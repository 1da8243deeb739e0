"""Model registry: every model as a function (long, cell, grid) -> scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grids import grid_points
from ..operators.baselines import majority_class, mean_target
from ..operators.linear import fit_linear, score_linear
from ..operators.metrics import classification_metrics, regression_metrics
from ..operators.rfe import eliminate
from ..operators.kernels import MODELS as MACHINES
from ..operators.kernels import sweep_svm
from ..operators.logistic import sweep_logistic
from ..operators.trees import MODELS as TREES
from ..operators.trees import sweep_trees


@dataclass(frozen=True)
class Model:
    name: str
    regression: bool
    sweep: Callable[[DataFrame, list[str], dict], DataFrame]


def _single(scores: DataFrame, cell: list[str]) -> DataFrame:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return scores.withColumn("grid_index", F.lit(0)).withColumn("params", empty)


def _majority(long, cell, grid):
    return _single(classification_metrics(majority_class(long, cell), cell), cell)


def _mean(long, cell, grid):
    return _single(regression_metrics(mean_target(long, cell), cell), cell)


def class_list(long: DataFrame) -> list[float]:
    """The classes of a classification target in the training rows, whose number the sample sizes bound."""
    return sorted(r["y"] for r in long.where("set = 'train'").select("y").distinct().collect())


def _linear(kind: str, classifier: bool):
    def sweep(long, cell, grid):
        classes = class_list(long) if classifier else None
        train = long.where("set = 'train'")
        supports = None
        if kind == "rfe-ridge":
            wanted = sorted({p["rfe__n_features_to_select"] for p in grid_points(grid)})
            supports = eliminate(train, cell, wanted, classes)
        weights = fit_linear(train, cell, kind, grid, classifier, classes=classes, supports=supports)
        return score_linear(long, weights, cell, classifier)
    return sweep


def _cells(sweep, name: str):
    return lambda long, cell, grid: sweep(long, name, grid, cell)


MODELS: dict[str, Model] = {}


def register(name: str, regression: bool, sweep) -> None:
    """Add a model; `sweep` gets (cell..., sample_id, set, x, y) and returns one score row per grid point."""
    MODELS[name] = Model(name, regression, sweep)


register("majority-cls", False, _majority)
register("mean-reg", True, _mean)
register("ols-reg", True, _linear("ols", False))
for _kind in ("ridge", "pca-ridge", "rfe-ridge"):
    register(f"{_kind}-cls", False, _linear(_kind, True))
    register(f"{_kind}-reg", True, _linear(_kind, False))
for _name, (_classifier, _) in TREES.items():
    register(_name, not _classifier, _cells(sweep_trees, _name))
for _name, (_classifier, _) in MACHINES.items():
    register(_name, not _classifier, _cells(sweep_svm, _name))
register("logistic-regression-cls", False, _cells(sweep_logistic, "logistic-regression-cls"))
