"""Logistic regression for all cells and grid points in one job: Newton steps by conjugate gradients, run to the optimum.

The loss is |w|^2 / 2 + C x the sum of the log losses on standardised inputs; intercepts are not penalised. Two classes have one
set of weights, more have one each (multinomial). Cells too large for a task are fitted over the whole cluster (:mod:`mllib`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .cells import CELL_VALUES, Cell, fit_cells, small_cells, sweep_cells
from .grids import grid_points

GRADIENT, MOST_STEPS = 1e-9, 200
WEIGHTS = "grid_index INT, output INT, coef ARRAY<DOUBLE>, intercept DOUBLE"


def optimise(x: np.ndarray, label: np.ndarray, outputs: int, c: float) -> np.ndarray:
    """Weights (outputs, 1 + features), the intercept first; `label` counts classes from 0, with one output 1 is positive."""
    a = np.hstack([np.ones((len(x), 1)), x])
    hit = (label == 1).astype(float)[None] if outputs == 1 else (label == np.arange(outputs)[:, None]).astype(float)
    ridge = np.r_[0.0, np.ones(x.shape[1])]
    w = np.zeros((outputs, a.shape[1]))

    def shares(w):
        z = w @ a.T
        if outputs == 1:
            return 1.0 / (1.0 + np.exp(-z)), np.logaddexp(0, z).sum() - (hit * z).sum()
        top = z.max(axis=0)
        e = np.exp(z - top)
        total = e.sum(axis=0)
        return e / total, (np.log(total) + top).sum() - (hit * z).sum()

    def loss(w, data):
        return c * data + (ridge * w * w).sum() / 2

    p, data = shares(w)
    for _ in range(MOST_STEPS):
        gradient = c * (p - hit) @ a + ridge * w
        size = np.sqrt((gradient ** 2).sum())
        if np.abs(gradient).max() <= GRADIENT * max(1.0, c * len(x)):
            break

        def curve(d):
            z = d @ a.T
            z = p * (1 - p) * z if outputs == 1 else p * (z - (p * z).sum(axis=0))
            return c * z @ a + ridge * d

        step, left = np.zeros_like(w), -gradient
        along, norm = left, (left * left).sum()
        for _ in range(4 * w.size):
            if np.sqrt(norm) <= min(0.1, np.sqrt(size)) * size:
                break
            bent = curve(along)
            bend = (along * bent).sum()
            if bend <= 1e-14 * (along * along).sum():
                break
            rate = norm / bend
            step, left = step + rate * along, left - rate * bent
            new = (left * left).sum()
            along, norm = left + new / norm * along, new
        slope, now, rate = (gradient * step).sum(), loss(w, data), 1.0
        if not slope < 0:
            break
        while True:
            p_next, data_next = shares(w + rate * step)
            if loss(w + rate * step, data_next) <= now + 1e-4 * rate * slope or rate < 1e-10:
                break
            rate /= 2
        if rate < 1e-10:
            break
        w, p, data = w + rate * step, p_next, data_next
    return w


def fit(cell: Cell, points: list[dict], keep=None) -> np.ndarray:
    """Predictions (points, rows); `keep` gets a row of WEIGHTS per output, for standardised inputs."""
    names = np.array(cell.classes)
    if len(names) < 2:
        return np.full((len(points), len(cell.y)), names[0])
    outputs = 1 if len(names) == 2 else len(names)
    train, out = cell.train, []
    for i, p in enumerate(points):
        w = optimise(cell.scaled[train], cell.label[train], outputs, float(p.get("C", 1.0)))
        z = w[:, 1:] @ cell.scaled.T + w[:, :1]
        out.append(names[(z[0] > 0).astype(int)] if outputs == 1 else names[z.argmax(axis=0)])
        for k in range(outputs) if keep else ():
            keep(i, k, w[k, 1:].tolist(), float(w[k, 0]))
    return np.stack(out)


def sweep_logistic(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str], most: int = CELL_VALUES) -> DataFrame:
    """Scores (cell..., grid_index, params, metrics) for every cell and grid point."""
    from .mllib import sweep_mllib
    points = grid_points(grid)
    cells, small, large = small_cells(long, cell, most)
    out = sweep_cells(small, cell, points, True, fit, cells)
    return out if large.isEmpty() else out.unionByName(sweep_mllib(large, name, points, cell))


def weight_tables(long: DataFrame, grid: dict | list[dict], cell: list[str]) -> DataFrame:
    """(cell..., grid_index, output, coef, intercept) on standardised inputs."""
    return fit_cells(long, cell, grid_points(grid), True, fit, small_cells(long, cell)[0], WEIGHTS)
