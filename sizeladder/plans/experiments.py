"""Experiment definitions as tables: expansion and referential checks.

`experiments` has (experiment, dataset, features ARRAY, targets ARRAY, method ARRAY, cni ARRAY,
models ARRAY, balanced, quantile, grid); the last three may be NULL and then take the global value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RUN_KEY


def expand_experiments(experiments: DataFrame, balanced: bool = False, quantile: bool = False,
                       grid: str = "default") -> DataFrame:
    """Every combination an experiment asks for, one run per row (not yet canonical)."""
    wide = experiments
    for column, name in (("features", "features"), ("targets", "target"), ("method", "method"),
                         ("cni", "cni"), ("models", "model")):
        wide = wide.withColumn(f"_{name}", F.explode(column))
    return wide.select("experiment", "dataset", F.col("_model").alias("model"), F.col("_features").alias("features"),
                       F.col("_target").alias("target"), F.col("_method").alias("method"), F.col("_cni").alias("cni"),
                       F.coalesce("balanced", F.lit(balanced)).alias("balanced"),
                       F.coalesce("quantile", F.lit(quantile)).alias("quantile"),
                       F.coalesce("grid", F.lit(grid)).alias("grid"))


def canonical_runs(runs: DataFrame) -> DataFrame:
    """A run without method or without covariates has neither; equal runs are kept once."""
    off = (F.col("method") == "none") | (F.col("cni") == "none")
    return (runs.withColumn("method", F.when(off, "none").otherwise(F.col("method")))
            .withColumn("cni", F.when(off, "none").otherwise(F.col("cni")))
            .select(*RUN_KEY).distinct())


def expand_cells(runs: DataFrame, sizes: list[int], seeds: list[int]) -> DataFrame:
    """Runs x sizes x seeds; both lists are configuration."""
    return (runs.withColumn("n", F.explode(F.array(*[F.lit(int(n)) for n in sizes])))
            .withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))))


def route_sources(runs: DataFrame) -> DataFrame:
    """The stored variant each role of a run reads: the corrected one is named by its covariates."""
    def variant(*methods):
        return F.when(F.col("method").isin(*methods), F.col("cni")).otherwise("none")
    return (runs.withColumn("features_variant", variant("correct-x", "correct-both"))
            .withColumn("targets_variant", variant("correct-y", "correct-both")))


def _missing(values: DataFrame, known: DataFrame, on: list[str], message) -> DataFrame:
    return values.join(known, on, "left_anti").select("experiment", message.alias("message"))


def validate_experiments(experiments: DataFrame, catalog: DataFrame, models: DataFrame, grids: DataFrame,
                         grid: str = "default") -> DataFrame:
    """All violations as (experiment, message).

    `catalog` is (dataset, role, name), `models` (model, regression), `grids` (grid, model).
    """
    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    datasets = catalog.select("dataset").distinct()
    unknown = _missing(experiments, datasets, ["dataset"], text("dataset '", F.col("dataset"), "' is not known"))
    good = experiments.join(datasets, "dataset", "left_semi")
    checks = [unknown]
    for column, role, label in (("features", "features", "feature"), ("targets", "targets", "target"),
                                ("cni", "covariates", "confound_correction_cni")):
        names = good.select("experiment", "dataset", F.explode(column).alias("name"))
        if role == "covariates":
            names = names.where("name <> 'none'")
        known = catalog.where(F.col("role") == role).select("dataset", "name")
        checks.append(_missing(names, known, ["dataset", "name"],
                               text(f"{label} '", F.col("name"), "' must exist in dataset '", F.col("dataset"), "'")))
    used = experiments.select("experiment", F.coalesce("grid", F.lit(grid)).alias("grid"), "method",
                              F.explode("models").alias("model"))
    checks.append(_missing(used, models, ["model"], text("model '", F.col("model"), "' is not defined")))
    named = used.select("experiment", "grid").distinct()
    all_grids = grids.select("grid").distinct()
    checks.append(_missing(named, all_grids, ["grid"], text("grid '", F.col("grid"), "' is not defined")))
    checks.append(_missing(used.join(all_grids, "grid", "left_semi"), grids, ["grid", "model"],
                           text("grid '", F.col("grid"), "' has no hyperparameters for model '", F.col("model"), "'")))
    checks.append(regression_required(used, models))
    return reduce(lambda a, b: a.unionByName(b), checks).distinct()


def regression_required(used: DataFrame, models: DataFrame) -> DataFrame:
    """Correcting the target only suits regression models; `used` is (experiment, model, method ARRAY)."""
    corrected = F.filter("method", lambda m: m.isin("correct-y", "correct-both"))
    return (used.join(models.where("not regression").select("model"), "model", "left_semi")
            .withColumn("_m", F.explode(corrected))
            .select("experiment", F.concat(F.lit("model '"), F.col("model"), F.lit("' must be a regression model for '"),
                                           F.col("_m"), F.lit("'")).alias("message")))
