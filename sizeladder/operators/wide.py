"""Linear models on more features than a square matrix of them fits anywhere.

The covariance matrix is never formed. All a solver needs are products of it with a few vectors, X' (X q): one pass
in which every task multiplies its own rows and hands over vectors, which are summed in the JVM. Rows stay where they
lie. The vectors of some cells advance side by side, one job per pass for all of them, and what the driver holds is
their search spaces, features x columns, with a stated bound (BASIS_VALUES); it does not grow with the rows.

Principal components: randomised block subspace iteration that keeps the residuals of earlier passes in the space
(Rayleigh-Ritz on it, thick restarts), until all residuals are below `tolerance` times the largest value. Ridge and
ordinary least squares: one space, started from the products with the targets and a few random columns, serves all
penalties, as shifting the matrix does not change the space; where it grows too long, it starts again from what is left of the targets,
and a search without progress over 20 starts fails with an ArithmeticError. Least squares gives the solution of least norm.

Constant columns count with spread 1 and get weight 0. Components beyond the rank are not distinguishable from none
and get weight 0. A cell of one row has weights 0. No rows give no weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .gram import fields, matrix, sum_vectors, vector, width_of
from .grids import grid_points

WIDE_FEATURES = 4_000  # beyond it a square matrix of features (128 MB) is not formed
BASIS_VALUES = 60_000_000  # doubles of the search spaces that the driver holds at a time (480 MB)
BLOCK = 128  # most columns that are multiplied in one pass
SPARE = 10  # columns beyond the components asked for
SEARCHED = 512  # columns of a space of solutions before it starts again
COMPANIONS = 16  # random columns that go along with targets, so that fewer passes are needed
PART_BYTES = 64 << 20  # rows of one task
BATCH_BYTES = 16 << 20  # rows that a Python worker gets at a time
SLICE = 256  # features of one row of results
TOLERANCE = 1e-10


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what `new` adds to the space of `basis`; dependent columns are left out."""
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        if not new.shape[1]:
            break
        left, size, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, size > 1e-10]
    return new


class Space:
    """Orthonormal columns, their products with the matrix, and the columns to be multiplied next (`block`)."""

    def __init__(self, start: np.ndarray, most: int):
        self.most = most
        self.basis = self.products = np.empty((len(start), 0))
        self.block = orthonormal(start, self.basis)

    def absorb(self, product: np.ndarray) -> None:
        """Take the products of `block`, then choose the next one; none is left once the search is over."""
        self.basis = np.hstack([self.basis, self.block])
        self.products = np.hstack([self.products, product])
        h = self.basis.T @ self.products
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        self.block = np.empty((len(product), 0))
        rest = self.residuals(values, vectors)
        if rest.shape[1]:
            self.block = orthonormal(rest[:, :BLOCK], self.basis)

    def residuals(self, values, vectors) -> np.ndarray:
        """What is still wrong, one column per unfinished vector; may restart the space."""
        raise NotImplementedError


class Components(Space):
    """The k largest values and their vectors."""

    def __init__(self, width: int, k: int, tolerance: float = TOLERANCE, seed: int = 0):
        self.k, self.tolerance = k, tolerance
        self.keep = min(width, max(k + SPARE, BLOCK))
        start = np.random.default_rng(seed).normal(size=(width, min(width, BLOCK)))
        super().__init__(start, self.keep + 2 * BLOCK)

    def residuals(self, values, vectors):
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        k, ahead = min(self.k, len(values)), min(self.keep, len(values))
        candidates = self.basis @ vectors[:, :ahead]
        self.values, self.vectors = values[:k], candidates[:, :k]
        rest = self.products @ vectors[:, :ahead] - candidates * values[:ahead]
        open_ = np.linalg.norm(rest, axis=0) > self.tolerance * max(values[0], 0.0)
        # candidates beyond the k-th go along, which takes fewer passes
        rest = rest[:, open_ if open_[:k].any() else open_ & False]
        if not rest.shape[1] and k < self.k and self.basis.shape[1] < len(self.basis) and values[-1] > 1e-12 * values[0]:
            # all found so far are exact, and there may be more in a part of the space not looked at
            rest = np.random.default_rng(self.basis.shape[1]).normal(size=(len(self.basis), BLOCK))
        if rest.shape[1] and self.basis.shape[1] + min(BLOCK, rest.shape[1]) > self.most:
            kept = vectors[:, :self.keep]
            self.basis, self.products = self.basis @ kept, self.products @ kept
        return rest


class Solutions(Space):
    """Solutions of (A + penalty) w = target for all penalties and all columns of the target."""

    def __init__(self, target: np.ndarray, penalties: list[float], most: int = SEARCHED, tolerance: float = TOLERANCE):
        self.targets = {p: target.copy() for p in penalties}
        self.solved = {p: np.zeros_like(target) for p in penalties}
        self.norm = np.linalg.norm(target, axis=0)
        self.tolerance, self.best, self.idle, self.most = tolerance, np.inf, 0, most
        super().__init__(np.hstack([target, self.companions(target)]), most)

    def companions(self, rows: np.ndarray) -> np.ndarray:
        return np.random.default_rng(0).normal(size=(len(rows), min(COMPANIONS, self.most // 2)))

    def weights(self, penalty: float) -> np.ndarray:
        return self.solved[penalty] + self.found[penalty] if self.basis.shape[1] else self.solved[penalty]

    def residuals(self, values, vectors):
        real = values > max(values[-1], 0.0) * 1e-12
        self.found, left, worst, rest = {}, {}, 0.0, np.empty((len(self.basis), 0))
        for penalty, target in self.targets.items():
            inverse = np.zeros(len(values))
            inverse[real] = 1.0 / (values[real] + penalty)
            small = vectors @ (inverse[:, None] * (vectors.T @ (self.basis.T @ target)))
            self.found[penalty] = self.basis @ small
            left[penalty] = target - self.products @ small - penalty * self.found[penalty]
            size = np.linalg.norm(left[penalty], axis=0)
            floor = self.tolerance * self.norm + 1e-14 * (values[-1] + penalty) * np.linalg.norm(self.weights(penalty), axis=0)
            excess = (size / np.maximum(floor, np.finfo(float).tiny)).max(initial=0.0)
            if excess > max(worst, 1.0):
                worst, rest = excess, left[penalty][:, size > floor]
        if not rest.shape[1]:
            return rest
        last = min(COMPANIONS, self.most // 2, self.products.shape[1])
        if self.basis.shape[1] + rest.shape[1] + last > self.most:
            # residuals of single starts go up and down
            self.idle = 0 if worst < self.best else self.idle + 1
            if self.idle > 20:
                raise ArithmeticError(f"no solution within {self.tolerance}: residual {worst * self.tolerance} of the target")
            self.best = min(worst, self.best)
            for penalty in self.targets:
                self.solved[penalty] = self.weights(penalty)
            self.targets = left
            self.basis = self.products = np.empty((len(rest), 0))
            return np.hstack([rest, self.companions(rest)])
        return np.hstack([rest, self.products[:, -last:]])


def _sums(rows: DataFrame, cell: list[str], known: dict, width: int) -> dict:
    """{cell: matrix} of Xs' (Xs q), or Xs' (y - mean) where there is no q, from {cell: (mean, sd, y mean, q)}."""
    many = isinstance({f.name: f.dataType for f in rows.schema.fields}["y"], T.ArrayType)

    def add_up(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, idx in _places(batch, cell).items():
                part = batch.take(pa.array(idx))
                mean, sd, centre, q = known[key]
                x = (matrix(part.column("x"), part.num_rows) - mean) / sd
                if q is None:
                    y = part.column("y")
                    right = (matrix(y, len(y)) if many else vector(y).reshape(-1, 1)) - centre
                else:
                    right = x @ q
                if key in held:
                    held[key][0] += x.T @ right
                else:
                    held[key] = [x.T @ right, [part.column(c)[:1] for c in cell]]
        for total, sample in held.values():
            starts = list(range(0, width, SLICE))
            keys = [pa.array([s[0].as_py()] * len(starts), s.type) for s in sample]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(starts, pa.int32()),
                 pa.array([total[s:s + SLICE].ravel() for s in starts], pa.list_(pa.float64()))],
                names=[*cell, "i", "values"])

    parts = rows.select(*cell, "x", "y").mapInArrow(add_up, f"{fields(rows, cell)}, i INT, `values` ARRAY<DOUBLE>")
    summed = sum_vectors(parts, [*cell, "i"], "values").toArrow()  # features x columns per cell
    out, starts = {}, summed.column("i").to_numpy()
    for key, idx in _places(summed, cell).items():
        order = idx[np.argsort(starts[idx])]
        values = summed.column("values").take(pa.array(order)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[key] = values.reshape(width, -1)
    return out


def _places(table, cell: list[str]) -> dict:
    """{cell: row numbers} of an Arrow table or batch."""
    found = table.select(cell).to_pandas().groupby(cell, sort=False).indices.values()
    return {tuple(table.column(c)[int(idx[0])].as_py() for c in cell): idx for idx in found}


def _facts(rows: DataFrame, cell: list[str], width: int) -> dict:
    """{cell: (rows, means, spreads, target means)}; a column with one value has spread 1."""
    y = F.col("y") if isinstance({f.name: f.dataType for f in rows.schema.fields}["y"], T.ArrayType) else F.array("y")
    both = array_to_vector(F.concat(F.col("x").cast("array<double>"), y.cast("array<double>")))
    stats = rows.groupBy(*cell).agg(Summarizer.metrics("count", "mean", "variance").summary(both).alias("s"))
    out = {}
    for r in stats.select(*cell, "s.count", vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v")).collect():
        n, mean = r["count"], np.array(r["m"])
        sd = np.sqrt(np.maximum(np.array(r["v"][:width]) * (n - 1) / n, 0))
        out[tuple(r[c] for c in cell)] = (n, mean[:width], np.where(sd > 0, sd, 1.0), mean[width:])
    return out


def _advance(rows: DataFrame, cell: list[str], facts: dict, spaces: dict, width: int) -> None:
    """Passes over the rows, those of the cells in `spaces`, until every search is over."""
    while open_ := {k: s for k, s in spaces.items() if s.block.shape[1]}:
        some = rows if len(open_) == len(spaces) else _of(rows, cell, list(open_))
        products = _sums(some, cell, {k: (facts[k][1], facts[k][2], None, s.block) for k, s in open_.items()}, width)
        for key, space in open_.items():
            space.absorb(products[key])


def _of(rows: DataFrame, cell: list[str], keys: list[tuple]) -> DataFrame:
    """Rows of a few cells."""
    types = T.StructType([rows.schema[c] for c in cell])
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(keys, types)), cell, "left_semi")


def stored_rows(train: DataFrame, cell: list[str], width: int) -> DataFrame:
    """Training rows, stored in parts of bounded bytes; Python workers get batches of bounded bytes."""
    spark = train.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))
    parts = max(spark.sparkContext.defaultParallelism, -(-train.count() * width * 8 // PART_BYTES))
    return store(train.select(*cell, "sample_id", "x", "y").repartition(parts, "sample_id").drop("sample_id"), "wide")


def groups_of_cells(rows: DataFrame, cell: list[str], columns: int, width: int) -> list[list[tuple]]:
    """Cells in groups whose search spaces, `columns` wide and with their products, the driver holds at a time."""
    if 2 * columns * width > BASIS_VALUES:
        raise ValueError(f"{columns} columns of {width} features exceed BASIS_VALUES = {BASIS_VALUES}")
    keys = [tuple(r) for r in rows.groupBy(*cell).count().drop("count").collect()]
    most = max(1, BASIS_VALUES // (2 * columns * width))
    return [keys[i:i + most] for i in range(0, len(keys), most)]


def principal(train: DataFrame, cell: list[str], k: int, tolerance: float = TOLERANCE) -> DataFrame:
    """(cell..., component, value, vector) of the k largest principal values of standardised training rows.

    Values are those of the correlation matrix times the number of rows, components count from 1, and the sign of a
    vector is arbitrary. A cell has at most as many components as features.
    """
    width = width_of(train)
    k = min(k, width)
    rows = stored_rows(train, cell, width)
    ddl = f"{fields(rows, cell)}, component INT, value DOUBLE, vector ARRAY<DOUBLE>"
    out = rows.sparkSession.createDataFrame([], ddl)
    for keys in groups_of_cells(rows, cell, min(width, k + SPARE + 3 * BLOCK), width):
        some = _of(rows, cell, keys)
        facts = _facts(some, cell, width)
        spaces = {key: Components(width, k, tolerance) for key in keys}
        _advance(some, cell, facts, spaces, width)
        found = [(*key, j + 1, float(s.values[j]), s.vectors[:, j].tolist()) for key, s in spaces.items() for j in range(len(s.values))]
        out = out.unionByName(store(rows.sparkSession.createDataFrame(found, ddl), "principal"))
    return out


def fit_wide(train: DataFrame, cell: list[str], kind: str, grid: dict, schema: str,
             classes: list[float] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """What :func:`linear.fit_linear` returns, `schema` its columns, for any number of features.

    `train` holds (cell..., sample_id, x, y), with `y` a number, or an array of -1 and 1 per class.
    """
    points = grid_points(grid)
    width = width_of(train)
    rows = stored_rows(train, cell, width)
    spark = rows.sparkSession
    penalty = {"ols": lambda p: 0.0, "ridge": lambda p: float(p["alpha"])}.get(kind, lambda p: float(p["ridge__alpha"]))
    most = SEARCHED
    if kind == "pca-ridge":
        wanted = int(min(max(p["pca__n_components"] for p in points), width))
        columns = min(width, wanted + SPARE + 3 * BLOCK)
    else:
        columns = most + COMPANIONS + (2 * len(points) + 2) * len(classes or [0])
    out = spark.createDataFrame([], schema)
    for keys in groups_of_cells(rows, cell, columns, width):
        some = _of(rows, cell, keys)
        facts = _facts(some, cell, width)
        cross = _sums(some, cell, {k: (*f[1:], None) for k, f in facts.items()}, width)
        present = {k: [j for j in range(len(f[3])) if classes is None or f[3][j] > -1.0 + 1e-9] for k, f in facts.items()}
        shown = {k: p[1:] if classes is not None and len(p) == 2 else p for k, p in present.items()}
        if kind == "pca-ridge":
            # the rank of the centred rows bounds what can be found
            spaces = {k: Components(width, min(wanted, max(1, f[0])), tolerance) for k, f in facts.items()}
        else:
            spaces = {k: Solutions(cross[k][:, shown[k]], sorted({penalty(p) for p in points}), most, tolerance) for k in facts}
        _advance(some, cell, facts, spaces, width)
        lines = []
        for key, (n, mean, sd, centre) in facts.items():
            base = centre[shown[key]]
            for index, point in enumerate(points):
                if kind == "pca-ridge":
                    s = spaces[key]
                    k = int(min(point["pca__n_components"], n, width, len(s.values)))
                    values, vectors = s.values[:k], s.vectors[:, :k]
                    real = values > max(s.values[0], 0.0) * 1e-12
                    inverse = np.where(real, 1.0 / np.where(real, values + penalty(point), 1.0), 0.0)
                    w = vectors @ (inverse[:, None] * (vectors.T @ cross[key][:, shown[key]]))
                else:
                    w = spaces[key].weights(penalty(point))
                w = w / sd[:, None]
                lines.append((*key, index, {c: float(v) for c, v in point.items()},
                              [classes[j] for j in present[key]] if classes is not None else [],
                              w.T.ravel().tolist(), (base - mean @ w).tolist(), mean.tolist(), base.tolist(),
                              float(centre[0]) if classes is None else 0.0))
        out = out.unionByName(store(spark.createDataFrame(lines, schema), "weights"))
    return out
