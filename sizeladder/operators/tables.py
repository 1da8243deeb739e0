"""Tables behind the figures, and run keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, log_grid, power_law, to_number_or_zero
from ..schema import CATEGORY_COLUMNS
from .select import validation_metric

KEY_FIELDS = ["features", "target", "method", "cni", "balanced", "quantile", "grid"]  # fixed values


def run_key(*columns: str) -> Column:
    """File-name form of a run: its fields joined by `_`."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in (columns or KEY_FIELDS)])


def parse_run_key(path: Column) -> Column:
    """STRUCT of the run fields of `.../<dataset>/statistics/<model>/<seven fields>.stats.json`.

    Any other shape fails the job.
    """
    parts = F.split(path, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.stats\.json$", "")
    fields = F.split(name, "_")
    ok = (F.size(parts) >= 4) & (F.size(fields) == len(KEY_FIELDS))
    value = F.struct(F.get(parts, F.size(parts) - 4).alias("dataset"), F.get(parts, F.size(parts) - 2).alias("model"),
                     *[F.get(fields, F.lit(i)).alias(k) for i, k in enumerate(KEY_FIELDS)])
    error = F.raise_error(F.concat(F.lit("Invalid filename structure: "), name))
    return F.when(ok, value).otherwise(error.cast(
        "struct<dataset:string,model:string," + ",".join(f"{k}:string" for k in KEY_FIELDS) + ">"))


def confound_label() -> Column:
    return F.concat_ws("-", "method", "cni")


def hyphenate(df: DataFrame) -> DataFrame:
    """`_` to `-` in column names and in text values."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[(F.translate(F.col(c), "_", "-") if c in text else F.col(c)).alias(c.replace("_", "-"))
                       for c in df.columns])


def curve_id(columns: list[str] | None = None) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in (columns or CATEGORY_COLUMNS)])


def explode_curve(df: DataFrame, keep: list[str]) -> DataFrame:
    """Curve arrays (x, y_mean, y_std) to one row per size."""
    return df.select(*keep, F.inline(F.arrays_zip("x", "y_mean", "y_std")))


def curve_table(points: DataFrame, keep: list[str], lower: float | None = -1.0) -> DataFrame:
    """Tidy curve rows: y clipped below, spread made numeric, clipped at 1, missing spread 0."""
    spread = to_number_or_zero(F.col("y_std").cast("string"))
    return points.select(*keep, "n", clip(F.col("y_mean"), lower=lower).alias("y"),
                         clip(spread, upper=1.0).alias("y_std"))


def error_bars(curves: DataFrame) -> DataFrame:
    return (curves.withColumn("y_min", F.col("y") - F.col("y_std"))
            .withColumn("y_max", F.col("y") + F.col("y_std")))


def axis_domain(curves: DataFrame, by: list[str], column: str = "n") -> DataFrame:
    return curves.groupBy(*by).agg((F.min(column) * 0.9).alias("low"), (F.max(column) * 1.1).alias("high"))


def filter_curves(curves: DataFrame, selections: dict[str, list]) -> DataFrame:
    """Keep rows whose columns are among the selected values; an empty selection does not filter."""
    for column, values in selections.items():
        if values:
            curves = curves.where(F.col(column).isin(list(values)))
    return curves


def attach_baseline(curves: DataFrame, method: str) -> DataFrame:
    """All curves of one correction method plus the uncorrected ones."""
    plain = curves.where("method = 'none' and cni = 'none'")
    return plain if method == "none" else curves.where(F.col("method") == method).unionByName(plain)


def compare_by(curves: DataFrame, varying: str, fixed: dict) -> DataFrame:
    """Curves that agree on `fixed` and differ in `varying`, sorted by it.

    Comparing by covariates also brings in the curve without any correction.
    """
    fixed = dict(fixed)
    if varying == "cni":
        curves = attach_baseline(curves, fixed.pop("method"))
    for column, value in fixed.items():
        curves = curves.where(F.col(column) == F.lit(value))
    return curves.orderBy(varying)


def attach_bootstrap(points: DataFrame, fits: DataFrame, run: list[str]) -> DataFrame:
    """Left join of curves and bootstrap parameters: curves without any stay."""
    return points.join(fits, run, "left")


def fit_lines(fits: DataFrame, keep: list[str], largest: float, points: int = 100,
              smallest: float = 128.0) -> DataFrame:
    """Each fitted power law on a logarithmic grid up to `largest`; unusable parameters are skipped."""
    usable = fits
    for p in ("a", "b", "c"):
        usable = usable.withColumn(p, F.col(p).cast("string").try_cast("double"))
    usable = usable.where("a is not null and b is not null and c is not null")
    grid = usable.select(*keep, "a", "b", "c", F.posexplode(log_grid(smallest, largest, points)).alias("i", "n"))
    return grid.select(*keep, "i", "n", power_law(F.col("n"), F.col("a"), F.col("b"), F.col("c")).alias("y"))


def hyperparameter_table(best: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Long form (n, metric, hyperparameter, value) of the chosen values; the metric is clipped at -1."""
    metric = validation_metric(best.columns)
    if metric is None:
        raise ValueError("Neither 'r2_val' nor 'acc_val' found in the DataFrame")
    keep = keep or []
    wide = best.select(*keep, "n", clip(F.col(metric), lower=-1.0).alias(metric),
                       *[F.col(h).cast("double").alias(h) for h in names])
    return wide.unpivot([*keep, "n", metric], names, "hyperparameter", "value")


def hyperparameter_ranges(grids: DataFrame, key: list[str]) -> DataFrame:
    """Smallest and largest grid value of each hyperparameter, from (key..., param, values)."""
    return grids.select(*key, "param", F.array_min("values").alias("low"), F.array_max("values").alias("high"))
