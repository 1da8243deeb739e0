"""Performance metrics as aggregates over predictions or over metric sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETS = ("train", "val", "test")  # fixed values


def accuracy(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg((F.col(y) == F.col(yhat)).cast("double"))


def mae(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(F.col(y) - F.col(yhat)))


def mse(y: str = "y", yhat: str = "yhat") -> Column:
    return F.avg((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat)))


def r2(y: str = "y", yhat: str = "yhat") -> Column:
    """1 - SSE/SST in one pass; a constant target gives 1 when predicted exactly, else 0."""
    err = F.col(y) - F.col(yhat)
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    constant = F.min(y) == F.max(y)
    return (F.when(constant & (sse == 0), F.lit(1.0)).when(constant, F.lit(0.0))
            .otherwise(1.0 - sse / F.nullif(sst, F.lit(0.0))))


# metrics by kind; users may add their own aggregate expressions
REGISTRY = {
    "regression": {"r2": r2, "mae": mae, "mse": mse},
    "classification": {"acc": accuracy},
}


def evaluate(pred: DataFrame, by: list[str], metrics: dict) -> DataFrame:
    """Any aggregate expressions per (by..., set): name -> function without arguments that gives a column."""
    return pred.groupBy(*by, "set").agg(*[f().alias(name) for name, f in metrics.items()])


def confusion(pred: DataFrame, by: list[str]) -> DataFrame:
    """Counts per (by..., set, y, yhat); classes squared rows per set."""
    return pred.groupBy(*by, "set", "y", "yhat").agg(F.count(F.lit(1)).alias("cnt"))


def weighted_f1(counts: DataFrame, by: list[str]) -> DataFrame:
    """Support-weighted F1 and accuracy per (by..., set) from confusion counts."""
    keys = [*by, "set"]
    hit = F.when(F.col("y") == F.col("yhat"), F.col("cnt")).otherwise(0)
    sides = counts.select(*keys, F.inline(F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("cnt").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("cnt").alias("called")))))
    per_class = sides.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "called")])
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("called"))
    return per_class.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("acc"),
                                        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def _spread(per_set: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """One row per (by...) with columns metric_set."""
    aggs = [F.max(F.when(F.col("set") == s, F.col(m))).alias(f"{m}_{s}") for m in names for s in SETS]
    return per_set.groupBy(*by).agg(*aggs)


def classification_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    total = counts.groupBy(*by, "set", "y", "yhat").agg(F.sum("cnt").alias("cnt"))
    return _spread(weighted_f1(total, by), by, ["acc", "f1"])


def regression_scores(sums: DataFrame, by: list[str]) -> DataFrame:
    """Scores from the sums |e|, e^2, v, v^2 with v = y - (a constant of the cell)."""
    s = sums.groupBy(*by, "set").agg(*[F.sum(c).alias(c) for c in ("cnt", "s_abs", "s_sq", "s_y", "s_yy")],
                                     F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
    constant = F.col("y_min") == F.col("y_max")
    sst = F.col("s_yy") - F.col("s_y") * F.col("s_y") / F.col("cnt")
    r2_ = (F.when(constant & (F.col("s_sq") == 0), 1.0).when(constant, 0.0)
           .otherwise(1.0 - F.col("s_sq") / F.nullif(sst, F.lit(0.0))))
    per_set = s.select(*by, "set", r2_.alias("r2"), (F.col("s_abs") / F.col("cnt")).alias("mae"),
                       (F.col("s_sq") / F.col("cnt")).alias("mse"))
    return _spread(per_set, by, ["r2", "mae", "mse"])


def classification_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """acc_*/f1_* per (by...) from predictions (by..., set, y, yhat)."""
    return classification_scores(confusion(pred, by), by)


def regression_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """r2_*/mae_*/mse_* per (by...) from predictions (by..., set, y, yhat)."""
    return _spread(evaluate(pred, by, REGISTRY["regression"]), by, list(REGISTRY["regression"]))
