"""Fits of many cells in one job: a cell, with rows bounded by the configured sample sizes, is the unit of work.

The rows of a cell go to one task, or to a few that take a share of the grid each. Only scores leave a task, or predictions
or models where they are asked for. Cells of more than CELL_VALUES numbers are for the learners of :mod:`mllib`, which
spread a single fit over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import DRAW_BITS, draw_key
from .gram import fields, matrix, repeat_keys, vector
from .metrics import classification_scores, regression_scores

CELL_VALUES = 40_000_000  # rows x features of a cell that one task takes
HELD_SHARE = 10  # one training row in so many is held back where a model needs to know when to stop
PREDICTED = "grid_index INT, sample_id BIGINT, `set` STRING, y DOUBLE, yhat DOUBLE"
SCORED = ("grid_index INT, `set` STRING, y DOUBLE, yhat DOUBLE, cnt BIGINT, s_abs DOUBLE, s_sq DOUBLE, s_y DOUBLE, s_yy DOUBLE, "
          "y_min DOUBLE, y_max DOUBLE")


class Features:
    """Inputs of a cell with the rank of every value among the distinct ones of its column."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.values, self.ranks = [], np.empty(x.shape, dtype=np.int32, order="F")
        for f in range(x.shape[1]):
            values, self.ranks[:, f] = np.unique(x[:, f], return_inverse=True)
            self.values.append(values)


class Cell:
    """Rows of a cell: inputs, target, sets, draws for the held-back tenth and for bootstraps."""

    def __init__(self, x, y, sets, stop, boot, classes: list[float] | None):
        order = np.lexsort((np.arange(len(y)), boot))
        self.x, self.y, self.sets, self.stop = x[order], y[order], sets[order], stop[order]
        self.order, self.classes = order, classes
        self.train = self.sets == "train"
        if classes:
            self.label = np.searchsorted(classes, self.y)
            self.label[~np.isin(self.y, classes)] = -1
        else:
            self.mean, sd = self.y[self.train].mean(), self.y[self.train].std()
            self.sd = sd if sd > 0 else 1.0
            self.target = (self.y - self.mean) / self.sd
        limit = max(2 ** DRAW_BITS // HELD_SHARE, int(self.stop[self.train].min()) if self.train.any() else 0)
        self.held = self.train & (self.stop <= limit)
        self.fit = self.train & ~self.held
        if not self.fit.any():
            self.fit = self.train

    @cached_property
    def features(self) -> Features:
        return Features(self.x)

    @cached_property
    def scaled(self) -> np.ndarray:
        """Inputs standardised by the training rows; a column that is constant there keeps its spread."""
        mean, sd = self.x[self.train].mean(axis=0), self.x[self.train].std(axis=0)
        return (self.x - mean) / np.where(sd > 0, sd, 1.0)


def small_cells(long: DataFrame, cell: list[str], most: int = CELL_VALUES, square: bool = False) -> tuple[int, DataFrame, DataFrame]:
    """(number, rows) of the cells that a task takes, and the rows of larger ones (an empty table where there are none).

    A cell counts with its rows times its features, or times the larger of features and rows if `square`.
    """
    count, width = F.count(F.lit(1)), F.max(F.size("x"))
    sizes = long.groupBy(*cell).agg((count * (F.greatest(width, count) if square else width)).alias("_values"))
    found = sizes.agg(F.count_if(F.col("_values") <= most).alias("small"), F.count_if(F.col("_values") > most).alias("large")).first()
    if not found["large"]:
        return found["small"], long, long.limit(0)
    sizes = F.broadcast(sizes)  # one row per cell
    return (found["small"], long.join(sizes, cell).where(F.col("_values") <= most).drop("_values"),
            long.join(sizes, cell).where(F.col("_values") > most).drop("_values"))


def score_rows(index: int, sets, y, yhat, classifier: bool, centre: float) -> Iterator[tuple]:
    """Rows of SCORED for the predictions of one grid point."""
    for name in ("train", "val", "test"):
        a, b = y[sets == name], yhat[sets == name]
        if not len(a):
            continue
        if classifier:
            pairs, counts = np.unique(np.stack([a, b]), axis=1, return_counts=True)
            for (u, v), c in zip(pairs.T, counts):
                yield index, name, float(u), float(v), int(c), None, None, None, None, None, None
        else:
            e, v = a - b, a - centre
            yield (index, name, None, None, len(a), float(np.abs(e).sum()), float(e @ e), float(v.sum()), float(v @ v),
                   float(a.min()), float(a.max()))


def fit_cells(long: DataFrame, cell: list[str], points: list[dict], classifier: bool, fit, cells: int, give: str = "scores") -> DataFrame:
    """One fit per (cell, share of the points): (cell..., SCORED), (cell..., PREDICTED), or what the fit keeps.

    `fit(cell, points, keep)` returns predictions (points, rows). Where `give` is a schema that starts with the grid
    position, `keep(point, ...)` adds a row of it. A cell goes to as many tasks as it takes to keep the cluster busy,
    each with its share of the points.
    """
    workers = long.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(len(points), -(-2 * workers // max(1, cells))))
    keys = [*cell, "_share"]
    rows = long.select(*cell, F.explode(F.array(*[F.lit(i) for i in range(shares)])).alias("_share"), "sample_id", "set", "x",
                       F.col("y").cast("double").alias("y"), draw_key("stop", F.col("sample_id")).alias("stop"),
                       draw_key("boot", F.col("sample_id")).alias("boot"))
    schema = {"scores": SCORED, "predictions": PREDICTED}.get(give, give)

    def run(key, table):
        n = table.num_rows
        mine = list(range(key[-1].as_py(), len(points), shares))
        x, y = matrix(table.column("x"), n), vector(table.column("y"))
        sets = np.asarray(table.column("set").to_pylist(), dtype=object)
        order = np.argsort(table.column("sample_id").to_numpy(), kind="stable")
        ids = table.column("sample_id").to_numpy()[order]
        x, y, sets = x[order], y[order], sets[order]
        stop, boot = (table.column(c).to_numpy()[order] for c in ("stop", "boot"))
        train = sets == "train"
        out: list[tuple] = []
        if train.any():
            classes = np.unique(y[train]).tolist() if classifier else None
            here = Cell(x, y, sets, stop, boot, classes)
            here.ids = ids[here.order]
            keep = (lambda p, *row: out.append((mine[p], *row))) if schema is give else None
            yhat = fit(here, [points[i] for i in mine], keep)
            for p, i in enumerate(mine):
                if give == "scores":
                    out += score_rows(i, here.sets, here.y, yhat[p], classifier, 0.0 if classifier else float(here.mean))
                elif give == "predictions":
                    out += zip([i] * n, here.ids.tolist(), here.sets, here.y.tolist(), yhat[p].tolist())
        fields_ = target.fields[len(keys):]
        columns = list(zip(*out)) or [[]] * len(fields_)
        return pa.Table.from_arrays([*repeat_keys(key, len(out)), *[pa.array(c, f.type) for c, f in zip(columns, arrow[len(keys):])]],
                                    names=[*keys, *[f.name for f in fields_]])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    ddl = f"{fields(rows, keys)}, {schema}"
    target = StructType.fromDDL(ddl)
    arrow = list(to_arrow_schema(target))
    return rows.repartition(workers, *keys).groupBy(*keys).applyInArrow(run, ddl).drop("_share")


def parameters(long: DataFrame, points: list[dict]) -> DataFrame:
    """(grid_index, params) of a grid."""
    rows = [(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(points)]
    return long.sparkSession.createDataFrame(rows, "grid_index INT, params MAP<STRING,DOUBLE>")


def sweep_cells(long: DataFrame, cell: list[str], points: list[dict], classifier: bool, fit, cells: int) -> DataFrame:
    """Scores (cell..., grid_index, params, metrics) of cells that fit a task."""
    sums = fit_cells(long, cell, points, classifier, fit, cells)
    by = [*cell, "grid_index"]
    scored = classification_scores(sums, by) if classifier else regression_scores(sums, by)
    return scored.join(F.broadcast(parameters(long, points)), "grid_index")  # one row per grid point
