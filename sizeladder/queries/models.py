"""Models, selection, curves and the flagship query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..operators import curves
from ..operators.baselines import majority_class, mean_target
from ..operators.cells import parameters
from ..operators.confounds import regress_out
from ..operators.grids import feasible_grid, grid_points
from ..operators.kernels import dual_tables
from ..operators.logistic import weight_tables
from ..operators.prepare import with_mask
from ..operators.scaling import scale_features, target_statistics
from ..operators.select import select_best
from ..operators.splits import make_splits
from ..plans.grids import GRIDS
from ..operators.metrics import regression_metrics
from ..plans.models import MODELS, register
from ..plans.sweep import gather, learning_curve, split_rows, sweep
from .model_sql import agreeing_sql, boosting_sql, components_sql, elimination_sql, forest_sql, logistic_sql, optimal_sql
from .aggregates import BOOTSTRAP, FITTED, REPEATS, RESAMPLED, power_law_sql
from .base import (ORACLES, CURVE_POINTS, CURVE_RUN, ORDER_LONG, ORDER_ROWS, ORDER_SEEDS, ORDER_SIZES, RUN, VECTOR_LONG,
                   best_rows, order_long, order_rows, order_samples, points, query, rounded, stored, vector_long)

CELL = ["dataset", "n", "seed"]
SETS = ("train", "val", "test")


def _pick(scores, *metrics, digits=6):
    return scores.select("n", F.col("seed") if "seed" in scores.columns else F.col("s").alias("seed"),
                         *[rounded(F.col(f"{m}_{s}"), digits).alias(f"{m}_{s}") for m in metrics for s in SETS])


@query("m01_majority", "WITH " + VECTOR_LONG + """,
c AS (SELECT n, seed, y, count(*) AS c FROM long WHERE "set" = 'train' GROUP BY n, seed, y),
top AS (SELECT n, seed, y AS yhat FROM c QUALIFY row_number() OVER (PARTITION BY n, seed ORDER BY c DESC, y) = 1)
SELECT n, seed, sample_id, "set", y, yhat FROM long JOIN top USING (n, seed)""")
def majority(spark, sf):
    return majority_class(vector_long(spark, sf), ["n", "seed"]).select("n", "seed", "sample_id", "set", "y", "yhat")


@query("m02_mean", "WITH " + ORDER_LONG + """,
top AS (SELECT n, seed, avg(y) AS yhat FROM long WHERE "set" = 'train' GROUP BY n, seed)
SELECT n, seed, sample_id, "set", round(yhat, 3) AS yhat FROM long JOIN top USING (n, seed)""")
def mean(spark, sf):
    return (mean_target(order_long(spark, sf), ["n", "seed"])
            .select("n", "seed", "sample_id", "set", rounded(F.col("yhat"), 3).alias("yhat")))


# one feature: the standardised weight is sum(z (y - mean)) / (rows + alpha)
RIDGE_ONE = ORDER_LONG + """,
grid(grid_index, alpha) AS (VALUES (0, 0.1), (1, 1.0), (2, 10.0), (3, 100.0)),
moments AS (SELECT n, seed, avg(lines) AS m, stddev_pop(lines) AS s, avg(y) AS my, count(*) AS k, covar_pop(lines, y) AS cxy
            FROM long WHERE "set" = 'train' GROUP BY n, seed),
pred AS (SELECT n, seed, grid_index, alpha, "set", y, my + k * cxy / s / (k + alpha) * (lines - m) / s AS yhat
         FROM long JOIN moments USING (n, seed), grid),
per AS (SELECT n, seed, grid_index, any_value(CAST(alpha AS DOUBLE)) AS alpha, "set", 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2,
               avg(abs(y - yhat)) AS mae FROM pred GROUP BY n, seed, grid_index, "set"),
scores AS (SELECT n, seed, grid_index, any_value(alpha) AS alpha, max(r2) FILTER ("set" = 'train') AS r2_train,
           max(r2) FILTER ("set" = 'val') AS r2_val, max(r2) FILTER ("set" = 'test') AS r2_test,
           max(mae) FILTER ("set" = 'test') AS mae_test FROM per GROUP BY n, seed, grid_index)"""
ONE_GRID = {"alpha": [0.1, 1.0, 10.0, 100.0]}


@query("m03_ols", ("WITH " + RIDGE_ONE).replace("(VALUES (0, 0.1), (1, 1.0), (2, 10.0), (3, 100.0))", "(VALUES (0, 0.0))") + """
SELECT n, seed, round(r2_train, 6) AS r2_train, round(r2_val, 6) AS r2_val, round(r2_test, 6) AS r2_test FROM scores""")
def ols(spark, sf):
    return _pick(MODELS["ols-reg"].sweep(order_long(spark, sf, ("lines",)), CELL, {}), "r2")


@query("m04_ridge", "WITH " + RIDGE_ONE + """
SELECT n, seed, grid_index, alpha, round(r2_train, 6) AS r2_train, round(r2_val, 6) AS r2_val, round(r2_test, 6) AS r2_test,
       round(mae_test, 2) AS mae_test FROM scores""")
def ridge(spark, sf):
    s = MODELS["ridge-reg"].sweep(order_long(spark, sf, ("lines",)), CELL, ONE_GRID)
    return s.select("n", "seed", "grid_index", F.col("params")["alpha"].alias("alpha"),
                    *[rounded(F.col(f"r2_{k}")).alias(f"r2_{k}") for k in SETS], rounded(F.col("mae_test"), 2).alias("mae_test"))


OFFSET = 1.7e9  # as large as a timestamp, next to a spread of a few units


def _offset_long(spark, sf):
    return order_long(spark, sf, ("lines",)).withColumn("x", F.transform("x", lambda v: v + OFFSET))


@query("m03_ols_offset", ORACLES["m03_ols"])
def ols_offset(spark, sf):
    """A shift of the feature changes nothing."""
    return _pick(MODELS["ols-reg"].sweep(_offset_long(spark, sf), CELL, {}), "r2")


@query("m04_ridge_offset", ORACLES["m04_ridge"])
def ridge_offset(spark, sf):
    s = MODELS["ridge-reg"].sweep(_offset_long(spark, sf), CELL, ONE_GRID)
    return s.select("n", "seed", "grid_index", F.col("params")["alpha"].alias("alpha"),
                    *[rounded(F.col(f"r2_{k}")).alias(f"r2_{k}") for k in SETS], rounded(F.col("mae_test"), 2).alias("mae_test"))


def many_lines(spark, sf, features):
    samples = stored(_labelled(spark, sf, features))
    splits, _ = make_splits(samples, ORDER_SIZES, ORDER_SEEDS, RUN)
    return stored(gather(samples, splits, RUN))


def _labelled(spark, sf, features):
    """Two classes of orders: more than four lines or not."""
    o = order_rows(spark, sf)
    return o.select("dataset", "sample_id", F.array(*features).alias("x"), (F.col("lines") > 4).cast("double").alias("y"),
                    F.array("c_size", "c_price").alias("c"), F.lit(True).alias("valid"))


@query("m05_ridge_classifier", "WITH " + ORDER_LONG + """,
grid(grid_index, alpha) AS (VALUES (0, 0.1), (1, 10.0)),
t AS (SELECT *, CAST(lines > 4 AS DOUBLE) AS cls, CASE WHEN lines > 4 THEN 1.0 ELSE -1.0 END AS sgn FROM long),
moments AS (SELECT n, seed, avg(c_price) AS m, stddev_pop(c_price) AS s, avg(sgn) AS ms, count(*) AS k, covar_pop(c_price, sgn) AS cxy
            FROM t WHERE "set" = 'train' GROUP BY n, seed),
pred AS (SELECT n, seed, grid_index, "set", cls, CAST(ms + k * cxy / s / (k + alpha) * (c_price - m) / s > 0 AS DOUBLE) AS yhat
         FROM t JOIN moments USING (n, seed), grid)
SELECT n, seed, grid_index, round(avg(CAST(cls = yhat AS DOUBLE)) FILTER ("set" = 'train'), 6) AS acc_train,
       round(avg(CAST(cls = yhat AS DOUBLE)) FILTER ("set" = 'val'), 6) AS acc_val,
       round(avg(CAST(cls = yhat AS DOUBLE)) FILTER ("set" = 'test'), 6) AS acc_test FROM pred GROUP BY n, seed, grid_index""")
def ridge_classifier(spark, sf):
    s = MODELS["ridge-cls"].sweep(many_lines(spark, sf, ("c_price",)), CELL, {"alpha": [0.1, 10.0]})
    return s.select("n", "seed", "grid_index", *[rounded(F.col(f"acc_{k}")).alias(f"acc_{k}") for k in SETS])


# --- two inputs: principal components and elimination have a closed form ------------------------------------------

MINIMAL = GRIDS["minimal"]
PAIR = ("qty", "c_price")
SUBSET_ALPHAS = [float(a) for a in GRIDS["default"]["ridge-reg"]["alpha"]]
SUBSETS = [(k, a) for k in (1, 2) for a in SUBSET_ALPHAS]


def _all_scores(scores, classifier):
    columns = [("acc", 6), ("f1", 6)] if classifier else [("r2", 6), ("mae", 2)]
    return scores.select("n", F.col("s").alias("seed"), "grid_index",
                         *[rounded(F.col(f"{m}_{k}"), d).alias(f"{m}_{k}") for m, d in columns for k in SETS])


@query("m12_pca_ridge_regressor", components_sql("y", PAIR, SUBSETS))
def components(spark, sf):
    grid = {"pca__n_components": [1, 2], "ridge__alpha": SUBSET_ALPHAS}
    return _all_scores(sweep(order_long(spark, sf, PAIR), "pca-ridge-reg", grid, RUN), False)


@query("m13_rfe_ridge_classifier", elimination_sql("CASE WHEN lines > 4 THEN 1.0 ELSE -1.0 END", PAIR, SUBSETS, True))
def elimination_classes(spark, sf):
    grid = {"rfe__n_features_to_select": [1, 2], "ridge__alpha": SUBSET_ALPHAS}
    return _all_scores(sweep(two_class_long(spark, sf), "rfe-ridge-cls", grid, RUN), True)


@query("m14_rfe_ridge_regressor", elimination_sql("y", PAIR, SUBSETS, False))
def elimination(spark, sf):
    grid = {"rfe__n_features_to_select": [1, 2], "ridge__alpha": SUBSET_ALPHAS}
    return _all_scores(sweep(order_long(spark, sf, PAIR), "rfe-ridge-reg", grid, RUN), False)


# --- 64 inputs and ten classes: every score is worked out again by least squares on the rows themselves ------------

def dense_scores(long, points, components=None):
    """(cell..., grid_index, own_train, own_val, own_test): accuracies of ridge classifiers by least squares on [z; sqrt(alpha) I]."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, part = np.stack(rows["x"]), rows["y"].to_numpy(), rows["set"].to_numpy()
        train = part == "train"
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - mean) / np.where(sd > 0, sd, 1.0)
        classes = np.unique(y[train])
        t = np.where(y[train][:, None] == classes, 1.0, -1.0)
        turn = np.linalg.svd(z[train], full_matrices=False)[2].T
        out = []
        for i, p in enumerate(points):
            v = z if components is None else z @ turn[:, :int(p[components])]
            alpha = p["alpha"] if components is None else p["ridge__alpha"]
            a = np.vstack([v[train], np.sqrt(alpha) * np.eye(v.shape[1])])
            w = np.linalg.lstsq(a, np.vstack([t - t.mean(axis=0), np.zeros((v.shape[1], len(classes)))]), rcond=None)[0]
            hit = classes[(v @ w + t.mean(axis=0)).argmax(axis=1)] == y
            out.append([*rows.iloc[0][CELL], i, *[hit[part == s].mean() for s in SETS]])
        return pd.DataFrame(out, columns=[*CELL, "grid_index", *[f"own_{s}" for s in SETS]])

    schema = "dataset string, n int, seed int, grid_index int, own_train double, own_val double, own_test double"
    return long.groupBy(*CELL).applyInPandas(solve, schema)


def agreeing(long, model, grid, components=None):
    """Whether all accuracies of a model agree with those that least squares gives, per cell and grid point."""
    own = dense_scores(long, grid_points(feasible_grid(grid, 64)), components)
    scores = sweep(long, model, grid, RUN).withColumn("seed", F.col("s"))
    sizes = F.broadcast(long.where("set = 'train'").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_train")))  # one row per cell
    same = [F.abs(F.col(f"own_{k}") - F.col(f"acc_{k}")) < 1e-9 for k in SETS]
    return scores.join(own, [*CELL, "grid_index"]).join(sizes, CELL).select("n", "seed", "grid_index", "n_train", (same[0] & same[1] & same[2]).alias("agrees"))


@query("m05_ridge_classifier_ten_classes", agreeing_sql(VECTOR_LONG, 11))
def ridge_ten(spark, sf):
    return agreeing(vector_long(spark, sf), "ridge-cls", GRIDS["default"]["ridge-cls"])


@query("m11_pca_ridge_classifier", agreeing_sql(VECTOR_LONG, 44))
def components_ten(spark, sf):
    return agreeing(vector_long(spark, sf), "pca-ridge-cls", GRIDS["default"]["pca-ridge-cls"], "pca__n_components")


# --- trees: the SQL grows them itself -------------------------------------------------------------------------

FOREST_GRID = {"n_estimators": [5], "max_depth": [2, 4], "max_features": [1.0]}
BOOST_GRID = {"n_estimators": [18], "learning_rate": [0.1, 0.8], "max_depth": [2], "max_features": [1.0], "subsample": [1.0]}


def tree_long(spark, sf, classifier):
    """All sizes and seeds of the orders: whether an order has more than four lines, or what it is worth."""
    samples = order_samples(spark, sf, ("qty", "c_size", "c_price"))
    if classifier:
        samples = _labelled(spark, sf, ("qty", "c_size", "c_price"))
    else:
        samples = samples.withColumn("y", F.round("y", 4))
    samples = stored(samples.withColumn("x", F.array(F.col("x")[0], F.col("x")[1], F.round(F.col("x")[2], 4))))
    splits, _ = make_splits(samples, ORDER_SIZES, ORDER_SEEDS, RUN)
    return stored(gather(samples, splits, RUN, rows=split_rows(ORDER_SIZES, ORDER_SEEDS)))


TREE_TARGETS = {True: "lines > 4", False: "round(y, 4)"}
TREE_QUERIES = [
    ("m07_random_forest_classifier", "random-forest-cls", True, FOREST_GRID, forest_sql(TREE_TARGETS[True], True, [2, 4], 5)),
    ("m08_random_forest_regressor", "random-forest-reg", False, FOREST_GRID, forest_sql(TREE_TARGETS[False], False, [2, 4], 5)),
    ("m09_boosting_classifier", "xgb-cls", True, BOOST_GRID, boosting_sql(TREE_TARGETS[True], True, [0.1, 0.8], 2, 18)),
    ("m10_boosting_regressor", "xgb-reg", False, BOOST_GRID, boosting_sql(TREE_TARGETS[False], False, [0.1, 0.8], 2, 18)),
    ("m08_random_forest_default_grid", "random-forest-reg", False, GRIDS["default"]["random-forest-reg"], None),
    ("m09_boosting_default_grid", "xgb-cls", True, GRIDS["default"]["xgb-cls"], None),
    ("m10_boosting_default_grid", "xgb-reg", False, GRIDS["default"]["xgb-reg"], None),
]


def _register_tree(name, model, classifier, grid, sql):
    @query(name, sql)
    def run(spark, sf):
        return _all_scores(sweep(tree_long(spark, sf, classifier), model, grid, RUN), classifier)


for _args in TREE_QUERIES:
    _register_tree(*_args)


# --- models without a closed form: optimality of what they return ---------------------------------------------------

def two_class_long(spark, sf):
    """Orders of more than four lines, from two inputs, at all sizes and seeds."""
    samples = stored(_labelled(spark, sf, ("qty", "c_price")))
    splits, _ = make_splits(samples, ORDER_SIZES, ORDER_SEEDS, RUN)
    return stored(gather(samples, splits, RUN, rows=split_rows(ORDER_SIZES, ORDER_SEEDS)))


@query("m06_logistic_regression", logistic_sql("lines > 4", ("qty", "c_price"), 14))
def logistic(spark, sf):
    long = two_class_long(spark, sf)
    weights = weight_tables(long, {}, CELL).select(
        "n", "seed", rounded(F.col("intercept"), 5).alias("intercept"), rounded(F.col("coef")[0], 5).alias("w_1"),
        rounded(F.col("coef")[1], 5).alias("w_2"))
    return _all_scores(sweep(long, "logistic-regression-cls", {}, RUN), True).drop("grid_index").join(weights, ["n", "seed"])


def scaled_train(long, regression=False):
    """Training rows of every cell on the scale that models see."""
    rows = scale_features(long, CELL).where("set = 'train'")
    return rows.join(F.broadcast(target_statistics(long.where("set = 'train'"), CELL)), CELL).withColumn(  # one row per cell
        "y", (F.col("y") - F.col("y_mean")) / F.col("y_sd")).drop("y_mean", "y_sd") if regression else rows


@query("m06_logistic_ten_classes", optimal_sql(VECTOR_LONG, 1))
def logistic_ten(spark, sf):
    """All 64 inputs: the gradient at the weights, worked out anew from the rows, vanishes."""
    long = vector_long(spark, sf)
    weights = stored(weight_tables(long, {}, CELL))
    per_cell = F.broadcast(weights.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("output", "coef", "intercept"))).alias("w")))  # one row per cell
    train = long.where("set = 'train'")
    classes = F.broadcast(train.groupBy(*CELL).agg(F.array_sort(F.collect_set("y")).alias("classes")))
    z = F.transform("w", lambda o: o["intercept"] + F.aggregate(F.zip_with(o["coef"], "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    rows = scaled_train(long).join(per_cell, CELL).join(classes, CELL).withColumn("z", z).withColumn(
        "e", F.transform("z", lambda v: F.exp(v - F.array_max("z")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, v: s + v))
    off = F.transform("e", lambda v, k: v / F.col("total") - F.when(F.get("classes", k) == F.col("y"), 1.0).otherwise(0.0))
    parts = F.flatten(F.transform(off, lambda v: F.concat(F.array(v), F.transform("x", lambda c: v * c))))
    best = (F.array_position("z", F.array_max("z")) - 1).cast("int")
    sums = rows.groupBy(*CELL).agg(Summarizer.sum(array_to_vector(parts)).alias("g"), F.count(F.lit(1)).alias("n_train"), F.first("w").alias("w"),
                                   F.avg((F.get("classes", best) == F.col("y")).cast("double")).alias("acc"))
    ridge = F.flatten(F.transform("w", lambda o: F.concat(F.array(F.lit(0.0)), o["coef"])))
    worst = F.array_max(F.transform(F.zip_with(vector_to_array("g"), ridge, lambda a, b: a + b), lambda v: F.abs(v)))
    balance = F.aggregate(F.transform("w", lambda o: o["coef"][0]), F.lit(0.0), lambda s, v: s + v)  # weights of a penalised multinomial add up to 0
    scores = sweep(long, "logistic-regression-cls", {}, RUN)
    return sums.join(scores.withColumn("seed", F.col("s")), CELL).select(
        "n", "seed", F.lit(0).alias("grid_index"), "n_train", (F.abs(rounded(worst, 4)) + 0.0).alias("violation"),
        F.abs(rounded(balance, 4)).alias("imbalance"), (F.abs(F.col("acc") - F.col("acc_train")) < 1e-9).alias("agrees"))


def machine_conditions(long, name, grid):
    """Optimality of two-class or regression machines, from their support vectors and the kernel written as expressions."""
    classifier = name.endswith("cls")
    duals = stored(dual_tables(long, name, grid, CELL))
    points = F.broadcast(parameters(long, grid_points(grid)))  # one row per grid point
    train = stored(scaled_train(long, not classifier))
    support = duals.join(train.select(*CELL, "sample_id", F.col("x").alias("z")), [*CELL, "sample_id"]).join(points, "grid_index")
    dot = F.aggregate(F.zip_with("x", "z", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    gap = F.aggregate(F.zip_with("x", "z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    k = F.exp(-F.col("params")["gamma"] * gap) if name.startswith("rbf") else F.pow(dot / F.size("x"), F.col("params")["degree"])
    values = (train.join(support.drop("sample_id"), CELL).groupBy(*CELL, "grid_index", "sample_id", "y")
              .agg((F.sum(F.col("coef") * k) + F.first("bias")).alias("f"), F.first(F.col("params")["C"]).alias("c")))
    own = values.join(duals.select(*CELL, "grid_index", "sample_id", "coef"), [*CELL, "grid_index", "sample_id"], "left").fillna({"coef": 0.0})
    low = F.broadcast(train.groupBy(*CELL).agg(F.min("y").alias("low")))  # one row per cell
    own = own.join(low, CELL)
    f, a = F.col("f"), F.abs(F.col("coef"))
    at_limit = a >= F.col("c") * (1 - 1e-12)
    if classifier:
        m = F.when(F.col("y") == F.col("low"), f).otherwise(-f)
        off = F.when(a == 0, 1 - m).when(at_limit, m - 1).otherwise(F.abs(m - 1))
        score = F.avg(F.when(F.col("y") == F.col("low"), f > 0).otherwise(f <= 0).cast("double"))
    else:
        r = F.col("y") - f
        signed = r * F.signum("coef")
        off = F.when(a == 0, F.abs(r) - 0.1).when(at_limit, 0.1 - signed).otherwise(F.abs(signed - 0.1))
        score = 1 - F.sum(r * r) / F.count(F.lit(1))  # targets have variance 1
    per = own.groupBy(*CELL, "grid_index").agg(
        F.count(F.lit(1)).alias("n_train"), F.greatest(F.max(off), F.max(a - F.col("c")), F.lit(0.0)).alias("violation"),
        F.abs(F.sum("coef")).alias("imbalance"), score.alias("own"))
    metric = "acc_train" if classifier else "r2_train"
    scores = sweep(long, name, grid, RUN).withColumn("seed", F.col("s"))
    return per.join(scores, [*CELL, "grid_index"]).select(
        "n", "seed", "grid_index", "n_train", rounded(F.col("violation"), 2).alias("violation"), rounded(F.col("imbalance"), 4).alias("imbalance"),
        (F.abs(F.col("own") - F.col(metric)) < 1e-6).alias("agrees"))


def odd_vectors(spark, sf):
    return vector_long(spark, sf).withColumn("y", F.col("y") % 2)


MACHINE_QUERIES = [
    ("m15_rbf_svm_classifier", "rbf-kernel-svm-cls", lambda spark, sf: tree_long(spark, sf, True), MINIMAL["rbf-kernel-svm-cls"], ORDER_LONG, 2),
    ("m16_rbf_svm_regressor", "rbf-kernel-svm-reg", lambda spark, sf: tree_long(spark, sf, False), MINIMAL["rbf-kernel-svm-reg"], ORDER_LONG, 2),
    ("m17_poly_svm_classifier", "poly-kernel-svm-cls", lambda spark, sf: tree_long(spark, sf, True), MINIMAL["poly-kernel-svm-cls"], ORDER_LONG, 2),
    ("m18_poly_svm_regressor", "poly-kernel-svm-reg", lambda spark, sf: tree_long(spark, sf, False), MINIMAL["poly-kernel-svm-reg"], ORDER_LONG, 2),
    ("m18_poly_svm_sketch", "poly-kernel-svm-cls", odd_vectors, {"C": [1.0], "degree": [5]}, VECTOR_LONG, 1),
]


def _register_machine(query_name, name, long, grid, sql, points):
    @query(query_name, optimal_sql(sql, points))
    def run(spark, sf):
        return machine_conditions(long(spark, sf), name, grid)


for _args in MACHINE_QUERIES:
    _register_machine(*_args)


@query("f01_model_registry", "WITH " + ORDER_LONG + """,
top AS (SELECT n, seed, max(y) AS yhat FROM long WHERE "set" = 'train' GROUP BY n, seed)
SELECT n, seed, round(avg(abs(y - yhat)) FILTER ("set" = 'test'), 3) AS mae_test FROM long JOIN top USING (n, seed) GROUP BY n, seed""")
def own_model(spark, sf):
    """A model added by the user: the largest training target."""
    def largest(long, cell, grid):
        top = long.where("set = 'train'").groupBy(*cell).agg(F.max("y").alias("yhat"))
        return regression_metrics(long.join(F.broadcast(top), cell), cell)  # one row per cell
    register("largest-reg", True, largest)
    out = sweep(order_long(spark, sf), "largest-reg", {}, RUN)
    return out.select("n", F.col("s").alias("seed"), rounded(F.col("mae_test"), 3).alias("mae_test"))


@query("m19_confound_regression", "WITH " + ORDER_ROWS + """,
s AS (SELECT var_pop(c_size) AS v1, var_pop(c_price) AS v2, covar_pop(c_size, c_price) AS v12, avg(c_size) AS m1, avg(c_price) AS m2,
  covar_pop(c_size, qty) AS q1, covar_pop(c_price, qty) AS q2, avg(qty) AS mq,
  covar_pop(c_size, lines) AS l1, covar_pop(c_price, lines) AS l2, avg(lines) AS ml FROM order_rows)
SELECT sample_id, round(qty - mq - ((q1 * v2 - q2 * v12) * (c_size - m1) + (q2 * v1 - q1 * v12) * (c_price - m2)) / (v1 * v2 - v12 * v12), 5) + 0.0 AS qty,
       round(lines - ml - ((l1 * v2 - l2 * v12) * (c_size - m1) + (l2 * v1 - l1 * v12) * (c_price - m2)) / (v1 * v2 - v12 * v12), 5) + 0.0 AS lines
FROM order_rows, s""")
def confounds(spark, sf):
    o = stored(order_rows(spark, sf))
    x = with_mask(o.select("sample_id", F.array("qty", "lines").alias("data")))
    c = with_mask(o.select("sample_id", F.array("c_size", "c_price").alias("data")))
    return regress_out(x, c).select("sample_id", rounded(F.col("data")[0], 5).alias("qty"), rounded(F.col("data")[1], 5).alias("lines"))


# covariates in sixteenths and ones, so that the large offset itself rounds nothing away
COARSE = ORDER_ROWS + """,
coarse AS (SELECT sample_id, qty, lines, floor(c_size * 16) / 16 AS c_size, floor(c_price) AS c_price FROM order_rows),"""


@query("m19_confound_offset", "WITH " + COARSE + ORACLES["m19_confound_regression"].removeprefix("WITH " + ORDER_ROWS + ",").replace(
    "order_rows", "coarse"))
def confounds_offset(spark, sf):
    """Covariates of about 1e9 with spreads of a few units."""
    o = stored(order_rows(spark, sf))
    x = with_mask(o.select("sample_id", F.array("qty", "lines").alias("data")))
    size, price = F.floor(F.col("c_size") * 16) / 16, F.floor("c_price").cast("double")
    c = with_mask(o.select("sample_id", F.array(size + 2.0 ** 30, price - 2.0 ** 30).alias("data")))
    return regress_out(x, c).select("sample_id", rounded(F.col("data")[0], 5).alias("qty"), rounded(F.col("data")[1], 5).alias("lines"))


# two standardised features with correlation r: (k R + alpha I) w = k c has a closed form
@query("m20_grid_sweep", "WITH " + ORDER_LONG + """,
grid(grid_index, alpha) AS (VALUES """ + ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(map(float, GRIDS["default"]["ridge-reg"]["alpha"]))) + """),
m AS (SELECT n, seed, count(*) AS k, avg(qty) AS m1, avg(lines) AS m2, avg(y) AS my, stddev_pop(qty) AS s1, stddev_pop(lines) AS s2,
        covar_pop(qty, lines) / (stddev_pop(qty) * stddev_pop(lines)) AS r, covar_pop(qty, y) / stddev_pop(qty) AS c1,
        covar_pop(lines, y) / stddev_pop(lines) AS c2 FROM long WHERE "set" = 'train' GROUP BY n, seed),
w AS (SELECT *, k * ((k + alpha) * c1 - k * r * c2) / ((k + alpha) * (k + alpha) - k * r * k * r) AS w1,
        k * ((k + alpha) * c2 - k * r * c1) / ((k + alpha) * (k + alpha) - k * r * k * r) AS w2 FROM m, grid),
pred AS (SELECT n, seed, grid_index, alpha, "set", y, my + w1 * (qty - m1) / s1 + w2 * (lines - m2) / s2 AS yhat FROM long JOIN w USING (n, seed)),
per AS (SELECT n, seed, grid_index, any_value(alpha) AS alpha, "set", 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2,
          avg(abs(y - yhat)) AS mae FROM pred GROUP BY n, seed, grid_index, "set")
SELECT n, seed, grid_index, any_value(alpha) AS alpha, round(max(r2) FILTER ("set" = 'train'), 6) AS r2_train,
       round(max(r2) FILTER ("set" = 'val'), 6) AS r2_val, round(max(r2) FILTER ("set" = 'test'), 6) AS r2_test,
       round(max(mae) FILTER ("set" = 'test'), 2) AS mae_test FROM per GROUP BY n, seed, grid_index""")
def grid_sweep(spark, sf):
    """The whole default ridge grid for every size and seed."""
    s = sweep(order_long(spark, sf), "ridge-reg", GRIDS["default"]["ridge-reg"], RUN)
    return s.select("n", F.col("s").alias("seed"), "grid_index", F.col("params")["alpha"].alias("alpha"),
                    *[rounded(F.col(f"r2_{k}")).alias(f"r2_{k}") for k in SETS], rounded(F.col("mae_test"), 2).alias("mae_test"))


SELECTED = RIDGE_ONE + """,
chosen AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY n, seed ORDER BY r2_val DESC, grid_index) = 1)"""


@query("m21_model_selection", "WITH " + SELECTED + """
SELECT n, seed AS s, alpha, round(r2_val, 6) AS r2_val, round(r2_test, 6) AS r2_test FROM chosen""")
def selection(spark, sf):
    best = select_best(sweep(order_long(spark, sf, ("lines",)), "ridge-reg", ONE_GRID, RUN), RUN)
    return best.select("n", "s", F.col("params")["alpha"].alias("alpha"), rounded(F.col("r2_val")).alias("r2_val"),
                       rounded(F.col("r2_test")).alias("r2_test"))


@query("m22_power_law", FITTED + """
SELECT model, features, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM fit""")
def power_law(spark, sf):
    f = curves.fit_power_law(points(spark, sf), CURVE_RUN)
    return f.select(*CURVE_RUN, *[rounded(F.col(p), 4).alias(p) for p in "abc"])


@query("m23_bootstrap", "WITH " + RESAMPLED + """
SELECT model, features, CAST(rep AS INTEGER) AS rep, n, round(y, 10) AS y FROM resampled""")
def bootstrap(spark, sf):
    p = curves.bootstrap_points(best_rows(spark, sf), CURVE_RUN, "r2_test", REPEATS)
    return p.select(*CURVE_RUN, "rep", "n", rounded(F.col("y"), 10).alias("y"))


@query("m23_bootstrap_fits", BOOTSTRAP + """
SELECT model, features, CAST(rep AS INTEGER) AS rep, round(b, 3) AS b, round(c, 3) AS c FROM bfit""")
def fits(spark, sf):
    p = curves.bootstrap_points(best_rows(spark, sf), CURVE_RUN, "r2_test", REPEATS)
    return curves.bootstrap_fits(p, CURVE_RUN).select(*CURVE_RUN, "rep", rounded(F.col("b"), 3).alias("b"), rounded(F.col("c"), 3).alias("c"))


@query("m24_bootstrap_admissibility", "WITH " + CURVE_POINTS + f""",
signed AS (SELECT model, features, count(*) FILTER (coalesce(CASE WHEN features = 'P' THEN -1 ELSE 1 END * y_mean - y_sem > 0, FALSE)) - 3 AS dof
           FROM curve_points GROUP BY model, features)
SELECT model, features, CAST(dof AS INTEGER) AS dof, dof >= 2 AS fitted, CAST(CASE WHEN dof >= 2 THEN {REPEATS} ELSE 0 END AS BIGINT) AS n_fits FROM signed""")
def admissible(spark, sf):
    """Curves whose scores are negative have no valid size left, and so neither a fit nor a bootstrap."""
    best = best_rows(spark, sf).withColumn("r2_test", F.when(F.col("features") == "P", -F.col("r2_test")).otherwise(F.col("r2_test")))
    best = stored(best)
    fit = curves.fit_power_law(curves.curve_points(best, CURVE_RUN, "r2_test"), CURVE_RUN)
    boots = curves.bootstrap_fits(curves.bootstrap_points(best, CURVE_RUN, "r2_test", REPEATS), CURVE_RUN)
    n_fits = boots.groupBy(*CURVE_RUN).agg(F.count(F.lit(1)).alias("n_fits"))
    return fit.join(n_fits, CURVE_RUN, "left").select(*CURVE_RUN, "dof", F.col("a").isNotNull().alias("fitted"),
                                                      F.coalesce("n_fits", F.lit(0).cast("bigint")).alias("n_fits"))


@query("e01_learning_curve", "WITH " + SELECTED + """,
curve AS (SELECT 1 AS one, n, avg(r2_test) AS y_mean, stddev_samp(r2_test) AS y_std, stddev_samp(r2_test) / sqrt(count(*)) AS y_sem
          FROM chosen GROUP BY n),
usable AS (SELECT one, CAST(n AS DOUBLE) AS n, y_mean AS y FROM curve WHERE y_mean - y_sem > 0 QUALIFY count(*) OVER () >= 5),
""" + power_law_sql("usable", "one", "fit") + """
SELECT n, round(y_mean, 6) AS y_mean, round(y_std, 6) AS y_std, round(y_sem, 6) AS y_sem, coalesce(y_mean - y_sem > 0, FALSE) AS mask,
       round(a * power(n, -b) + c, 4) AS y_fit FROM curve LEFT JOIN fit USING (one)""")
def learning(spark, sf):
    """How well line counts predict the charge of an order at growing sample sizes, and the fitted curve."""
    samples = stored(order_samples(spark, sf, ("lines",)))
    out = learning_curve(samples, ORDER_SIZES, ORDER_SEEDS, RUN, "ridge-reg", ONE_GRID)
    joined = out["points"].join(F.broadcast(out["fit"].select("dataset", "a", "b", "c")), "dataset")
    from ..functions.numeric import power_law as value
    return joined.select("n", *[rounded(F.col(c)).alias(c) for c in ("y_mean", "y_std", "y_sem")], "mask",
                         rounded(value(F.col("n").cast("double"), F.col("a"), F.col("b"), F.col("c")), 4).alias("y_fit"))
