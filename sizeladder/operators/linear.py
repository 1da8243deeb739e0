"""Linear models for all cells and all hyperparameters in one job.

A training pass reduces every cell to its Gram matrix; one eigendecomposition per cell then serves the
whole regularisation grid, principal components included. A scoring pass applies all weights of a cell
to its rows and reduces them to metric sums. Standardisation is folded into the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .gram import chunk_of, fields, gram, gram_matrix, matrix, repeat_keys, ridge_weights, spectrum, vector, width_of
from .grids import grid_points
from .wide import WIDE_FEATURES, fit_wide

KINDS = {"ols": (), "ridge": ("alpha",), "pca-ridge": ("pca__n_components", "ridge__alpha"),
         "rfe-ridge": ("rfe__n_features_to_select", "ridge__alpha")}


def standardised(m: np.ndarray, d: int):
    """Training moments as :func:`gram_matrix` gives them: n, means, spreads, scaled covariances.

    Only a column that is the same number in every row has no spread.
    """
    n, mean, products = m[0, 0], m[0, 1:], m[1:, 1:]
    sd = np.sqrt(np.maximum(np.diag(products), 0) / n)
    sd = np.where(sd > 0, sd, 1.0)
    return n, mean, sd, products[:d, :d] / np.outer(sd[:d], sd[:d]), products[:d, d:] / sd[:d, None]


def weights_for(kind: str, params: dict, n: float, values, vectors, cross, support=None, scaled=None):
    """Weights on standardised inputs for one hyperparameter point."""
    if kind == "ols":
        return ridge_weights(values, vectors, cross, 0.0)
    if kind == "ridge":
        return ridge_weights(values, vectors, cross, float(params["alpha"]))
    alpha = float(params["ridge__alpha"])
    if kind == "pca-ridge":
        # more components than min(n, d) cannot exist; such points equal the largest possible one
        k = int(min(params["pca__n_components"], n, len(values)))
        return ridge_weights(values[-k:], vectors[:, -k:], cross, alpha)
    w = np.zeros_like(cross)
    sub_values, sub_vectors = spectrum(scaled[np.ix_(support, support)])
    w[support] = ridge_weights(sub_values, sub_vectors, cross[support], alpha)
    return w


def fit_linear(train: DataFrame, cell: list[str], kind: str, grid: dict, classifier: bool = False,
               rows: Column | None = None, classes: list[float] | None = None,
               supports: DataFrame | None = None) -> DataFrame:
    """Weights per (cell, grid point) from training rows (cell..., sample_id, x, y).

    Output: (cell..., grid_index, params MAP, classes ARRAY, coef ARRAY (outputs x features, flattened),
    intercept ARRAY, shift ARRAY, base ARRAY, centre). `rows` tells about how many rows a cell has (default: its column n).
    More than WIDE_FEATURES features go to :mod:`wide`, except for elimination.
    """
    points = grid_points(grid)
    rows = F.col("n") if rows is None else rows
    width = width_of(train)
    chunk, chunks = chunk_of(rows, width=width)
    inputs = ["x", "y"]
    source = train
    if classifier:
        classes = sorted(classes)
        source = train.withColumn("y", F.array(*[F.when(F.col("y") == c, 1.0).otherwise(-1.0) for c in classes]))
    schema = (f"{fields(source, cell)}, grid_index INT, params MAP<STRING,DOUBLE>, classes ARRAY<DOUBLE>, "
              "coef ARRAY<DOUBLE>, intercept ARRAY<DOUBLE>, shift ARRAY<DOUBLE>, base ARRAY<DOUBLE>, centre DOUBLE")
    if width > WIDE_FEATURES and supports is None:
        return fit_wide(source, cell, kind, grid, schema, classes if classifier else None)
    g = gram(source, cell, inputs, chunk, chunks)
    outputs = len(classes) if classifier else 1
    if supports is not None:
        g = g.join(F.broadcast(supports), cell)  # (cell, supports) : one row per cell
    label_list = list(classes) if classifier else []
    eliminated = supports is not None

    def solve(key, table):
        m = gram_matrix(table.select(["i", "row"]))
        d = m.shape[0] - 1 - outputs
        n, mean, sd, scaled, cross = standardised(m, d)
        values, vectors = spectrum(scaled)
        chosen = None
        if eliminated:
            chosen = {int(s["size"]): s["features"] for s in table.column("supports")[0].as_py()}
        present = [j for j in range(outputs) if not classifier or mean[d + j] > -1.0 + 1e-9]
        if classifier and len(present) == 2:
            present_out = [present[1]]
        else:
            present_out = present
        coef, intercept, base, ids, params = [], [], [], [], []
        for index, point in enumerate(points):
            support = None
            if kind == "rfe-ridge":
                support = chosen[int(min(point["rfe__n_features_to_select"], d))]
            w = weights_for(kind, point, n, values, vectors, cross[:, present_out], support, scaled)
            w = w / sd[:d, None]
            coef.append(w.T.ravel().tolist())
            intercept.append((mean[d:][present_out] - mean[:d] @ w).tolist())
            base.append(mean[d:][present_out].tolist())
            ids.append(index)
            params.append(list(point.items()))
        k = len(ids)
        labels = [label_list[j] for j in present] if classifier else []
        centre = float(mean[d]) if not classifier else 0.0
        return pa.Table.from_arrays(
            [*repeat_keys(key, k), pa.array(ids, pa.int32()),
             pa.array(params, pa.map_(pa.string(), pa.float64())),
             pa.array([labels] * k, pa.list_(pa.float64())), pa.array(coef, pa.list_(pa.float64())),
             pa.array(intercept, pa.list_(pa.float64())), pa.array([mean[:d].tolist()] * k, pa.list_(pa.float64())),
             pa.array(base, pa.list_(pa.float64())), pa.array([centre] * k, pa.float64())],
            names=[*cell, "grid_index", "params", "classes", "coef", "intercept", "shift", "base", "centre"])

    return g.groupBy(*cell).applyInArrow(solve, schema)


def predict_class(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Largest score wins, the first on ties; with one output its sign decides between two classes."""
    if scores.shape[1] == 1:
        return labels[(scores[:, 0] > 0).astype(int)] if len(labels) > 1 else np.repeat(labels, len(scores))
    return labels[np.argmax(scores, axis=1)]


def score_linear(long: DataFrame, weights: DataFrame, cell: list[str], classifier: bool = False,
                 rows: Column | None = None) -> DataFrame:
    """Metrics per (cell, grid point) on all three sets; predictions never leave the tasks.

    `rows` (an upper bound on the rows of a cell, from cell columns only) sets the number of chunks.
    """
    chunk, chunks = chunk_of(F.col("n") * 3 if rows is None else rows, width=width_of(long))
    keys = [*cell, "_chunk"]
    left = long.select(*cell, chunk.alias("_chunk"), "set", "x", "y")
    # one copy of a cell's weights for each of its chunks
    right = weights.select(*cell, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_chunk"),
                           "grid_index", "classes", "coef", "shift", "base", "centre")

    def sums(key, rows_, models):
        n = rows_.num_rows
        out = {name: [] for name in ("grid_index", "set", "y", "yhat", "cnt", "s_abs", "s_sq", "s_y", "s_yy",
                                     "y_min", "y_max")}
        if n and models.num_rows:
            x, y = matrix(rows_.column("x"), n), vector(rows_.column("y"))
            sets = np.asarray(rows_.column("set").to_pylist())
            d = x.shape[1]
            masks = {s: sets == s for s in ("train", "val", "test")}
            # around the training means, as the intercept of columns with a large offset would cost digits
            x = x - np.array(models.column("shift")[0].as_py(), dtype=float)
            for j in range(models.num_rows):
                index = models.column("grid_index")[j].as_py()
                b = np.array(models.column("base")[j].as_py(), dtype=float)
                w = np.array(models.column("coef")[j].as_py(), dtype=float).reshape(-1, d)
                scores = x @ w.T + b
                if classifier:
                    labels = np.array(models.column("classes")[j].as_py(), dtype=float)
                    yhat = predict_class(scores, labels)
                    for s, mask in masks.items():
                        pairs, counts = np.unique(np.stack([y[mask], yhat[mask]]), axis=1, return_counts=True)
                        for (a, p), c in zip(pairs.T, counts):
                            _append(out, index, s, a, p, int(c))
                else:
                    centre = models.column("centre")[j].as_py()
                    err = y - scores[:, 0]
                    for s, mask in masks.items():
                        if mask.any():
                            e, v = err[mask], y[mask] - centre
                            _append(out, index, s, None, None, int(mask.sum()), float(np.abs(e).sum()),
                                    float(e @ e), float(v.sum()), float(v @ v), float(y[mask].min()),
                                    float(y[mask].max()))
        k = len(out["set"])
        types = {"grid_index": pa.int32(), "set": pa.string(), "cnt": pa.int64()}
        return pa.Table.from_arrays(
            [*repeat_keys(key, k), *[pa.array(v, types.get(c, pa.float64())) for c, v in out.items()]],
            names=[*keys, *out])

    schema = (f"{fields(left, keys)}, grid_index INT, `set` STRING, y DOUBLE, yhat DOUBLE, cnt BIGINT, "
              "s_abs DOUBLE, s_sq DOUBLE, s_y DOUBLE, s_yy DOUBLE, y_min DOUBLE, y_max DOUBLE")
    parts = spread(left, *keys).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(sums, schema)
    from .metrics import classification_scores, regression_scores
    by = [*cell, "grid_index"]
    scored = classification_scores(parts, by) if classifier else regression_scores(parts, by)
    return weights.select(*by, "params").join(scored, by)


def _append(out, index, s, y, yhat, cnt, s_abs=None, s_sq=None, s_y=None, s_yy=None, y_min=None, y_max=None):
    for name, value in zip(out, (index, s, y, yhat, cnt, s_abs, s_sq, s_y, s_yy, y_min, y_max)):
        out[name].append(value)
