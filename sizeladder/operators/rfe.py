"""Recursive feature elimination with leave-one-out ridge.

Every step drops one feature per cell. The ridge penalty of a step is the one with the smallest leave-one-out error; everything
else comes from the moments. A cell that fits a task is read once and eliminated there, all cells side by side. Larger cells
go in step with each other, with one pass over their chunks per dropped feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, store
from .cells import CELL_VALUES, small_cells
from .gram import chunk_of, fields, gram, gram_matrix, matrix, repeat_keys, ridge_weights, spectrum, vector, width_of
from .linear import standardised

ALPHAS = (0.1, 1.0, 10.0)  # fixed values: penalties tried while eliminating


def eliminate(train: DataFrame, cell: list[str], sizes: list[int], classes: list[float] | None = None,
              most: int = CELL_VALUES) -> DataFrame:
    """Feature subsets per cell: (cell..., supports ARRAY<STRUCT<size, features>>) for the wanted sizes."""
    _, small, large = small_cells(train, cell, most)
    out = _eliminate_in_tasks(small, cell, sizes, classes)
    return out if large.isEmpty() else out.unionByName(_eliminate_in_step(large, cell, sizes, classes))


def _eliminate_in_tasks(train, cell, sizes, classes):
    labels = sorted(classes) if classes else None

    def run(key, table):
        n = table.num_rows
        x, y = matrix(table.column("x"), n), vector(table.column("y"))
        if labels:
            kept = labels[1:] if len(labels) == 2 else labels
            y = np.where(y[:, None] == np.array(kept), 1.0, -1.0)
        else:
            y = y[:, None]
        order = np.lexsort((*y.T, *x.T))  # sums do not depend on the order of arrival
        x, y = x[order], y[order]
        spread = x.std(axis=0)
        z, t = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0), y - y.mean(axis=0)
        d = x.shape[1]
        wanted = sorted({min(int(s), d) for s in sizes})
        products, cross = z.T @ z, z.T @ t
        active, out = np.arange(d), []
        for size in range(d, wanted[0] - 1, -1):
            if size in wanted:
                out.append({"size": size, "features": active.tolist()})
            if size > wanted[0]:
                values, vectors = spectrum(products[np.ix_(active, active)])
                turned, best = z[:, active] @ vectors, None
                for a in ALPHAS:
                    w = ridge_weights(values, vectors, cross[active], a)
                    lever = 1.0 / n + (turned * turned / (values + a)).sum(axis=1)
                    error = (((t - z[:, active] @ w) / np.maximum(1.0 - lever, 1e-12)[:, None]) ** 2).sum()
                    if best is None or error < best[0]:
                        best = (error, w)
                active = np.delete(active, int((best[1] ** 2).sum(axis=1).argmin()))
        return pa.Table.from_arrays([*repeat_keys(key, 1), pa.array([out], _SUPPORTS)], names=[*cell, "supports"])

    rows = train.select(*cell, "x", F.col("y").cast("double").alias("y"))
    return rows.groupBy(*cell).applyInArrow(run, f"{fields(rows, cell)}, supports ARRAY<STRUCT<size: INT, features: ARRAY<INT>>>")


_SUPPORTS = pa.list_(pa.struct([("size", pa.int32()), ("features", pa.list_(pa.int32()))]))


def _eliminate_in_step(train, cell, sizes, classes):
    out = list(sorted(classes)) if classes else None
    one_output = out is None or len(out) == 2
    source = train
    if out:
        kept = out[1:] if one_output else out
        source = train.withColumn("y", F.array(*[F.when(F.col("y") == c, 1.0).otherwise(-1.0) for c in kept]))
    else:
        source = train.withColumn("y", F.array("y"))
    chunk, chunks = chunk_of(F.col("n"), width=width_of(train))
    rows = store(source.select(*cell, chunk.alias("_chunk"), "x", "y"))
    moments = store(gram(source, cell, ["x", "y"], chunk, chunks))
    width = rows.select(F.size("x").alias("d"), F.size("y").alias("k")).first()
    d, k = width["d"], width["k"]
    wanted = sorted({min(int(s), d) for s in sizes})
    state = materialise(rows.select(*cell).distinct().withColumn("active", F.sequence(F.lit(0), F.lit(d - 1))))
    supports = None
    for size in range(d, wanted[0] - 1, -1):
        if size in wanted:
            snap = state.select(*cell, F.lit(size).alias("size"), F.col("active").alias("features"))
            supports = snap if supports is None else supports.unionByName(snap)
        if size > wanted[0]:
            state = materialise(_drop_one(rows, moments, state, cell, chunks, d, k))
    return supports.groupBy(*cell).agg(F.collect_list(F.struct("size", "features")).alias("supports"))


def _drop_one(rows, moments, state, cell, chunks, d, k):
    tagged = moments.join(F.broadcast(state), cell)  # one row per cell

    def candidates(key, table):
        m = gram_matrix(table.select(["i", "row"]))
        active = np.array(table.column("active")[0].as_py(), dtype=int)
        n, mean, sd, scaled, cross = standardised(m, d)
        values, vectors = spectrum(scaled[np.ix_(active, active)])
        ws = [ridge_weights(values, vectors, cross[active], a) for a in ALPHAS]
        return pa.Table.from_arrays(
            [*repeat_keys(key, 1), pa.array([active.tolist()], pa.list_(pa.int32())),
             pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())),
             pa.array([sd[:d].tolist()], pa.list_(pa.float64())), pa.array([values.tolist()], pa.list_(pa.float64())),
             pa.array([vectors.ravel().tolist()], pa.list_(pa.float64())),
             pa.array([np.stack(ws).ravel().tolist()], pa.list_(pa.float64()))],
            names=[*cell, "active", "rows", "mean", "sd", "vals", "vecs", "ws"])

    models = tagged.groupBy(*cell).applyInArrow(
        candidates, f"{fields(tagged, cell)}, active ARRAY<INT>, rows DOUBLE, mean ARRAY<DOUBLE>, sd ARRAY<DOUBLE>, "
                    "vals ARRAY<DOUBLE>, vecs ARRAY<DOUBLE>, ws ARRAY<DOUBLE>")
    copies = models.withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keys = [*cell, "_chunk"]

    def left_out(key, data, model):
        n_rows = data.num_rows
        errors = []
        if n_rows and model.num_rows:
            get = lambda name: np.array(model.column(name)[0].as_py(), dtype=float)
            active, mean, sd, vals = get("active").astype(int), get("mean"), get("sd"), get("vals")
            q = len(active)
            vecs, ws = get("vecs").reshape(q, q), get("ws").reshape(len(ALPHAS), q, k)
            z = ((matrix(data.column("x"), n_rows) - mean[:d]) / sd)[:, active]
            y = matrix(data.column("y"), n_rows) - mean[d:]
            rot = z @ vecs
            for a, w in zip(ALPHAS, ws):
                lever = 1.0 / float(get("rows")) + (rot * rot / (vals + a)).sum(axis=1)
                e = (y - z @ w) / np.maximum(1.0 - lever, 1e-12)[:, None]
                errors.append(float((e * e).sum()))
        m = len(errors)
        return pa.Table.from_arrays(
            [*repeat_keys(key, m), pa.array(list(range(m)), pa.int32()), pa.array(errors, pa.float64())],
            names=[*keys, "a", "err"])

    losses = (rows.groupBy(*keys).cogroup(copies.groupBy(*keys))
              .applyInArrow(left_out, f"{fields(rows, keys)}, a INT, err DOUBLE")
              .groupBy(*cell, "a").agg(F.sum("err").alias("err")))
    best = (losses.withColumn("_p", F.row_number().over(Window.partitionBy(*cell).orderBy("err", "a")))
            .where("_p = 1").select(*cell, "a"))
    # squared weights of the chosen penalty, summed over outputs; the smallest goes, the first on ties
    q = F.size("active")
    weight = F.transform(F.sequence(F.lit(0), q - 1), lambda j: F.struct(
        F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0),
                    lambda acc, o: acc + F.pow(F.col("ws")[F.col("a") * q * k + j * k + o], F.lit(2.0))).alias("v"),
        j.alias("j")))
    weakest = F.array_min(weight)["j"]
    return (models.select(*cell, "active", "ws").join(best, cell)
            .withColumn("_drop", F.element_at("active", weakest + 1))
            .select(*cell, F.filter("active", lambda f: f != F.col("_drop")).alias("active")))
