"""Support vector machines with their true kernels, for all cells and grid points in one job.

A task takes a cell and a share of the grid. Points that differ only in their penalty, and the pairs of classes, share one
kernel matrix and are solved side by side: every step of sequential minimal optimisation picks, in each open problem, the pair
of variables with the largest second-order gain, and problems drop out when no pair violates optimality by more than TOLERANCE.
Classifiers hold one machine per pair of classes and vote, the first class on ties; regressors use the epsilon-insensitive
loss on scaled targets. Cells whose kernel matrix would exceed KERNEL_VALUES are fitted with feature maps over the whole
cluster (:mod:`mllib`).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from .cells import Cell, fit_cells, small_cells, sweep_cells
from .grids import grid_points

KERNEL_VALUES = 40_000_000  # rows x rows of a cell
BATCH_VALUES = 2_000_000    # variables of the problems that are solved side by side
TOLERANCE, EPSILON = 1e-3, 0.1
MOST_STEPS = 10_000_000
DUALS = "grid_index INT, output INT, sample_id BIGINT, coef DOUBLE, bias DOUBLE"


def kernel(kind: str, point: dict, a: np.ndarray, b: np.ndarray, variance: float) -> np.ndarray:
    """exp(-gamma |a - b|^2), or (gamma a.b + coef0)^degree; gamma is 1 / (width x variance of the inputs) unless it is given."""
    gamma = float(point.get("gamma", 1.0 / (a.shape[1] * variance) if variance > 0 else 1.0))
    products = a @ b.T
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] - 2 * products + (b * b).sum(axis=1), 0.0))
    return (gamma * products + float(point.get("coef0", 0.0))) ** int(point.get("degree", 3))


def solve(k: np.ndarray, signs: np.ndarray, linear: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed duals, bias) of problems min a'Qa / 2 + linear'a with signs'a = 0, 0 <= a <= penalty, Q = signs signs' k.

    `signs` is (problems, variables), a whole multiple of the rows of `k`; variables of sign 0 stay 0.
    """
    n, (count, size) = len(k), signs.shape
    diagonal = np.tile(np.diag(k), size // n)
    out, bias = np.zeros((count, size)), np.zeros(count)
    open_ = np.arange(count)
    s, a, g, c = signs.astype(float), np.zeros((count, size)), linear.astype(float).copy(), penalty.astype(float)[:, None]
    for _ in range(MOST_STEPS):
        v = -s * g
        up, low = np.where(s > 0, a < c, a > 0) & (s != 0), np.where(s > 0, a > 0, a < c) & (s != 0)
        rising, falling = np.where(up, v, -np.inf), np.where(low, v, np.inf)
        i = rising.argmax(axis=1)
        at = np.arange(len(open_))
        top, bottom = rising[at, i], falling.min(axis=1)
        done = ~(top - bottom >= TOLERANCE)
        if done.any():
            out[open_[done]] = s[done] * a[done]
            free = (a > 0) & (a < c) & (s != 0)
            middle = np.where(np.isfinite(top) & np.isfinite(bottom), (top + bottom) / 2, np.where(np.isfinite(top), top, bottom))
            some = free.sum(axis=1)
            mean = np.where(free, v, 0.0).sum(axis=1) / np.maximum(some, 1)
            bias[open_[done]] = np.where(some > 0, mean, np.where(np.isfinite(middle), middle, 0.0))[done]
            keep = ~done
            open_, s, a, g, c, v, low = open_[keep], s[keep], a[keep], g[keep], c[keep], v[keep], low[keep]
            i, top = i[keep], top[keep]
            if not len(open_):
                break
            at = np.arange(len(open_))
        row = np.tile(k[i % n], size // n)
        curve = np.maximum(diagonal[i][:, None] + diagonal - 2 * row, 1e-12)
        gap = top[:, None] - v
        j = np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax(axis=1)
        step = gap[at, j] / curve[at, j]
        room_i = np.where(s[at, i] > 0, c[:, 0] - a[at, i], a[at, i])
        room_j = np.where(s[at, j] > 0, a[at, j], c[:, 0] - a[at, j])
        step = np.minimum(step, np.minimum(room_i, room_j))
        a[at, i] += s[at, i] * step
        a[at, j] -= s[at, j] * step
        a[at, i], a[at, j] = np.clip(a[at, i], 0, c[:, 0]), np.clip(a[at, j], 0, c[:, 0])
        g += s * (step[:, None] * (row - np.tile(k[j % n], size // n)))
    else:
        out[open_], bias[open_] = s * a, (rising.max(axis=1) + falling.min(axis=1)) / 2
    return out, bias


def _groups(kind: str, points: list[dict]) -> dict[tuple, list[int]]:
    """Points that share a kernel."""
    out: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        out.setdefault(tuple(p.get(k) for k in (("gamma",) if kind == "rbf" else ("gamma", "degree", "coef0"))), []).append(i)
    return out


def fit_svm(kind: str):
    """A fit for :func:`fit_cells`; `keep` gets a row of DUALS for every support vector of every machine."""
    def fit(cell: Cell, points: list[dict], keep=None) -> np.ndarray:
        train = np.flatnonzero(cell.train)
        x, inputs = cell.scaled, cell.scaled[train]
        n, rows = len(train), len(x)
        yhat = np.zeros((len(points), rows))
        if cell.classes and len(cell.classes) < 2:
            return np.full_like(yhat, cell.classes[0])
        if cell.classes:
            pairs = list(combinations(range(len(cell.classes)), 2))
            label = cell.label[train]
            signs = np.stack([(label == p).astype(float) - (label == q) for p, q in pairs])
            linear = -np.abs(signs)
        else:
            pairs = [(0, 0)]
            signs = np.r_[np.ones(n), -np.ones(n)][None]
            linear = np.r_[EPSILON - cell.target[train], EPSILON + cell.target[train]][None]
        for mine in _groups(kind, points).values():
            k = kernel(kind, points[mine[0]], inputs, inputs, inputs.var())
            whole = kernel(kind, points[mine[0]], x, inputs, inputs.var())
            problems = [(i, m) for i in mine for m in range(len(pairs))]
            votes = np.zeros((len(points), rows, len(cell.classes or [0])))
            at_once = max(1, BATCH_VALUES // signs.shape[1])
            for s in range(0, len(problems), at_once):
                some = problems[s:s + at_once]
                which = np.array([m for _, m in some])
                penalty = np.array([float(points[i].get("C", 1.0)) for i, _ in some])
                duals, bias = solve(k, signs[which], linear[which], penalty)
                duals = duals.reshape(len(some), -1, n).sum(axis=1)
                value = duals @ whole.T + bias[:, None]
                for (i, m), d, b, f in zip(some, duals, bias, value):
                    if cell.classes:
                        p, q = pairs[m]
                        votes[i, :, p] += f > 0
                        votes[i, :, q] += ~(f > 0)
                    else:
                        yhat[i] = f * cell.sd + cell.mean
                    if keep:
                        for t in np.flatnonzero(d):
                            keep(i, m, int(cell.ids[train[t]]), float(d[t]), float(b))
            if cell.classes:
                for i in mine:
                    yhat[i] = np.array(cell.classes)[votes[i].argmax(axis=1)]
        return yhat
    return fit


MODELS = {f"{kind}-kernel-svm-{end}": (end == "cls", fit_svm(kind)) for kind in ("rbf", "poly") for end in ("cls", "reg")}


def sweep_svm(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str], most: int = KERNEL_VALUES) -> DataFrame:
    """Scores (cell..., grid_index, params, metrics) of one kernel machine for every cell and grid point."""
    from .mllib import sweep_mllib
    classifier, fit = MODELS[name]
    points = grid_points(grid)
    cells, small, large = small_cells(long, cell, most, square=True)
    out = sweep_cells(small, cell, points, classifier, fit, cells)
    return out if large.isEmpty() else out.unionByName(sweep_mllib(large, name, points, cell))


def dual_tables(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str]) -> DataFrame:
    """The support vectors as (cell..., grid_index, output, sample_id, coef, bias).

    The value of a machine at a row is bias + sum(coef x kernel). `output` numbers the pairs of classes, (0, 1), (0, 2) ...,
    whose first class is the positive one.
    """
    classifier, fit = MODELS[name]
    return fit_cells(long, cell, grid_points(grid), classifier, fit, small_cells(long, cell)[0], DUALS)
