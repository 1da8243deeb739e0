"""Confound regression: the part of the data that covariates predict linearly is removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dot
from ..schema import SAMPLE
from .gram import fields, gram_matrix, pivot_and_rest, repeat_keys, ridge_weights, spectrum, table_gram
from .prepare import require_aligned


def confound_coefficients(valid: DataFrame, run: list[str]) -> DataFrame:
    """Least-norm regression of every data column on (1, covariates).

    Returns (run..., coef ARRAY<ARRAY<DOUBLE>>, intercept ARRAY<DOUBLE>): one entry per data column; and the same
    line as `base` at the covariates `pivot` near their means, where covariates with a large offset keep their digits.
    The whole table takes part; it is reduced where it lies.
    """
    g = table_gram(valid.select(*run, "c", "x"), run, ["c", "x"])
    width = valid.groupBy(*run).agg(F.max(F.size("c")).alias("q"))
    tagged = g.join(F.broadcast(width), run)  # one row per run

    def solve(key, table):
        m, q = gram_matrix(table), int(table.column("q")[0].as_py())
        n, mean, cov = m[0, 0], m[0], m
        c, x = slice(1, 1 + q), slice(1 + q, None)
        scale = np.sqrt(np.maximum(np.diag(cov)[c], 0))
        scale = np.where(scale > 0, scale, 1.0)
        values, vectors = spectrum(cov[c, c] / np.outer(scale, scale))
        beta = ridge_weights(values, vectors, cov[c, x] / scale[:, None], 0.0) / scale[:, None]
        intercept = mean[x] - mean[c] @ beta
        pivot, rest = pivot_and_rest(table)
        q_pivot, at_pivot = pivot[:q], pivot[q:] + rest[q:] - rest[:q] @ beta
        return pa.Table.from_arrays(
            [*repeat_keys(key, 1), pa.array([beta.T.tolist()], pa.list_(pa.list_(pa.float64()))),
             *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (intercept, at_pivot, q_pivot)]],
            names=[*run, "coef", "intercept", "base", "pivot"])

    return tagged.groupBy(*run).applyInArrow(
        solve, f"{fields(tagged, run)}, coef ARRAY<ARRAY<DOUBLE>>, intercept ARRAY<DOUBLE>, base ARRAY<DOUBLE>, "
               "pivot ARRAY<DOUBLE>")


def residual(x, coef, intercept, c):
    """x - (intercept + coef . c) by data column."""
    predicted = F.zip_with(coef, intercept, lambda w, b: dot(w, c) + b)
    return F.zip_with(x, predicted, lambda v, p: v - p)


def regress_out(data: DataFrame, covariates: DataFrame, run: list[str] | None = None,
                check: bool = False) -> DataFrame:
    """Residuals of prepared `data` given prepared `covariates`; NULL arrays where either is invalid.

    Fitted on all jointly valid rows. The coefficients (features x covariates numbers per run) are
    broadcast, so the data is only joined and projected.
    """
    if check:
        require_aligned(data, covariates)
    run = run or []
    if not run:
        data, covariates = data.withColumn("_run", F.lit(0)), covariates.withColumn("_run", F.lit(0))
        return regress_out(data, covariates, ["_run"]).drop("_run")
    both = (data.select(*run, SAMPLE, F.col("data").alias("x"), F.col("mask").alias("_mx"))
            .join(covariates.select(*run, SAMPLE, F.col("data").alias("c"), F.col("mask").alias("_mc")),
                  [*run, SAMPLE])
            .withColumn("mask", F.col("_mx") & F.col("_mc")))
    coefs = F.broadcast(confound_coefficients(both.where("mask"), run))
    moved = F.zip_with("c", "pivot", lambda v, m: v - m)
    clean = F.when(F.col("mask"), residual(F.col("x"), F.col("coef"), F.col("base"), moved))
    return both.join(coefs, run, "left").select(*run, SAMPLE, clean.alias("data"), "mask")


def source_variant(method: str, role: str, cni: str) -> str:
    """Which stored variant of a role a method reads: the corrected one (named by cni) or `none`."""
    corrected = {"features": ("correct-x", "correct-both"), "targets": ("correct-y", "correct-both")}
    return cni if method in corrected.get(role, ()) else "none"
