"""Models fitted with pyspark.ml: one distributed fit per (cell, hyperparameter point).

Fits run through a bounded thread pool. Kernel machines are approximated by explicit feature maps.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import DRAW_BITS, draw_key
from ..session import scratch_path
from .grids import grid_points
from .metrics import classification_metrics, regression_metrics
from .scaling import scale_features, scale_targets, unscale_predictions

MAX_DEPTH = 30  # of Spark's tree learner; deeper trees of large cells stop there
RANDOM_FEATURES = 256  # size of a kernel's feature map, unless the grid names `random_features`
BOOSTING_TOLERANCE = 1e-4  # relative gain on the held-back rows below which boosting stops


def _subset(value, default: str) -> str:
    """An integer counts features, a fraction is a share; the two stay distinct."""
    if value is None:
        return default
    return str(value) if isinstance(value, int) else str(float(value))


def logistic(p, n, classes):
    return LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="yhat", standardization=False,
                              regParam=1.0 / (float(p.get("C", 1.0)) * n), maxIter=300, tol=1e-9)


def forest_classifier(p, n, classes):
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", predictionCol="yhat", seed=42,
                                  numTrees=int(p.get("n_estimators", 100)),
                                  maxDepth=min(int(p.get("max_depth", MAX_DEPTH)), MAX_DEPTH),
                                  featureSubsetStrategy=_subset(p.get("max_features"), "sqrt"))


def forest_regressor(p, n, classes):
    return RandomForestRegressor(featuresCol="_features", labelCol="y_scaled", predictionCol="yhat", seed=42,
                                 numTrees=int(p.get("n_estimators", 100)),
                                 maxDepth=min(int(p.get("max_depth", MAX_DEPTH)), MAX_DEPTH),
                                 featureSubsetStrategy=_subset(p.get("max_features"), "all"))


class OneVsRest:
    """One two-class model per class; the class with the largest margin wins, the first on ties.

    Unlike the estimator of the same name it keeps all input columns, which early stopping needs. Classes are
    numbered from 0.
    """

    def __init__(self, make, classes: int):
        self.make, self.classes, self.models = make, classes, []

    def fit(self, df: DataFrame) -> "OneVsRest":
        self.models = [self.make(f"_is_{i}", f"_raw_{i}").fit(df.withColumn(f"_is_{i}", (F.col("_label") == i).cast("double")))
                       for i in range(self.classes)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out, margins = df, []
        for i, model in enumerate(self.models):
            out = model.transform(out).drop("_p", "probability")
            margins.append(vector_to_array(f"_raw_{i}")[1])
        best = F.array_position(F.array(*margins), F.array_max(F.array(*margins)))
        return out.withColumn("yhat", (best - 1).cast("double"))


def _boost(cls, label, p, **columns):
    return cls(featuresCol="_features", labelCol=label, seed=42, maxIter=int(p.get("n_estimators", 100)),
               stepSize=float(p.get("learning_rate", 0.1)), subsamplingRate=float(p.get("subsample", 1.0)),
               maxDepth=min(int(p.get("max_depth", 3)), MAX_DEPTH), validationIndicatorCol="held_back",
               validationTol=float(p.get("tolerance", BOOSTING_TOLERANCE)),
               featureSubsetStrategy=_subset(p.get("max_features"), "all"), **columns)


def boosting_classifier(p, n, classes):
    """Early stopping is by relative improvement on a held-back tenth, not by ten flat rounds."""
    if classes <= 2:
        return _boost(GBTClassifier, "_label", p, predictionCol="yhat")
    return OneVsRest(lambda label, raw: _boost(GBTClassifier, label, p, predictionCol="_p").setRawPredictionCol(raw), classes)


def boosting_regressor(p, n, classes):
    return _boost(GBTRegressor, "y_scaled", p, predictionCol="yhat")


def svm_classifier(p, n, classes):
    def one(label, raw="rawPrediction", out="_p"):
        return LinearSVC(featuresCol="_features", labelCol=label, predictionCol=out, rawPredictionCol=raw,
                         standardization=False, regParam=1.0 / (float(p.get("C", 1.0)) * n), maxIter=100)
    return one("_label", out="yhat") if classes <= 2 else OneVsRest(one, classes)


def svm_regressor(p, n, classes):
    """Robust (Huber) loss stands in for the epsilon-insensitive one, which Spark does not have.

    It takes many more steps than the default to converge under a strong penalty.
    """
    return LinearRegression(featuresCol="_features", labelCol="y_scaled", predictionCol="yhat", loss="huber",
                            standardization=False, regParam=1.0 / (float(p.get("C", 1.0)) * n), maxIter=1000, tol=1e-8)


def random_fourier(df: DataFrame, gamma: float, width: int, features: int = RANDOM_FEATURES, out: str = "x") -> DataFrame:
    """Random features whose inner products approximate exp(-gamma |a - b|^2); fixed seed."""
    rng = np.random.RandomState(42)
    w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, features))
    shift = rng.uniform(0.0, 2.0 * np.pi, features)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        if not len(x):
            return x
        z = np.sqrt(2.0 / features) * np.cos(np.stack(x.to_numpy()) @ w + shift)
        return pd.Series(list(z))

    return df.withColumn(out, project("x"))


def polynomial(df: DataFrame, degree: int, width: int, features: int = RANDOM_FEATURES, out: str = "x") -> DataFrame:
    """Features of the homogeneous polynomial kernel (a.b / width)^degree.

    They are exact where the monomials of that degree are no more than `features`: each once, with the root of its
    multinomial coefficient as weight. Otherwise products of random sign projections (fixed seed) stand for them, whose
    inner product is the kernel on average. Both are the same kernel in the same scale.
    """
    count = math.comb(width + degree - 1, degree)
    if count <= features:
        monomials = list(combinations_with_replacement(range(width), degree))
        place = np.array(monomials, dtype=int).reshape(count, degree)
        weight = np.array([math.sqrt(math.factorial(degree) / math.prod(math.factorial(m.count(j)) for j in set(m)))
                           for m in monomials]) / width ** (degree / 2)
        signs = None
    else:
        signs = np.random.RandomState(42).choice([-1.0, 1.0], size=(degree, width, features)) / np.sqrt(width)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        if not len(x):
            return x
        rows = np.stack(x.to_numpy())
        if signs is None:
            return pd.Series(list(rows[:, place].prod(axis=2) * weight))
        z = np.ones((len(rows), features)) / np.sqrt(features)
        for s in signs:
            z *= rows @ s
        return pd.Series(list(z))

    return df.withColumn(out, project("x"))


def as_vector(df: DataFrame, point: dict, width: int) -> DataFrame:
    return df.withColumn("_features", array_to_vector("x"))


def map_size(point: dict) -> int:
    return int(point.get("random_features", RANDOM_FEATURES))


def rbf_features(df: DataFrame, point: dict, width: int) -> DataFrame:
    gamma = float(point.get("gamma", 1.0 / width))
    return as_vector(random_fourier(df, gamma, width, map_size(point)), point, width)


def poly_features(df: DataFrame, point: dict, width: int) -> DataFrame:
    return as_vector(polynomial(df, int(point.get("degree", 3)), width, map_size(point)), point, width)


# name: (is classifier, estimator factory, feature map)
ESTIMATORS = {
    "logistic-regression-cls": (True, logistic, as_vector),
    "random-forest-cls": (True, forest_classifier, as_vector),
    "random-forest-reg": (False, forest_regressor, as_vector),
    "xgb-cls": (True, boosting_classifier, as_vector),
    "xgb-reg": (False, boosting_regressor, as_vector),
    "rbf-kernel-svm-cls": (True, svm_classifier, rbf_features),
    "rbf-kernel-svm-reg": (False, svm_regressor, rbf_features),
    "poly-kernel-svm-cls": (True, svm_classifier, poly_features),
    "poly-kernel-svm-reg": (False, svm_regressor, poly_features),
}


def numbered_classes(df: DataFrame, classes: list[float]) -> DataFrame:
    """Labels of any kind as 0 .. K-1, with their number stated, so that no learner has to guess or limit it."""
    if not classes:
        return df
    place = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), F.col("y")) - 1
    names = {"ml_attr": {"name": "_label", "type": "nominal", "vals": [str(c) for c in classes]}}
    return df.withColumn("_label", F.when(place >= 0, place).cast("double")).withMetadata("_label", names)


def predict(long: DataFrame, name: str, point: dict, n: int, classes: list[float], width: int,
            first_draw: int = 0) -> DataFrame:
    """Fit on the training rows of one cell and predict all of its rows.

    A tenth of the rows by their draw, and the training row with the smallest one (`first_draw`) in any case, is held
    back to tell boosting when to stop.
    """
    is_classifier, make, features = ESTIMATORS[name]
    data = numbered_classes(features(long, point, width), classes if is_classifier else [])
    draw = draw_key("stop", F.col("sample_id"))
    data = data.withColumn("held_back", draw <= F.lit(max(2 ** DRAW_BITS // 10, first_draw)))
    model = make(point, n, len(classes)).fit(data.where("set = 'train'"))
    pred = model.transform(data)
    if not is_classifier:
        return unscale_predictions(pred)
    return pred.withColumn("yhat", F.get(F.array(*[F.lit(float(c)) for c in classes]), F.col("yhat").cast("int")))


def sweep_mllib(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str], threads: int = 4) -> DataFrame:
    """Scores (cell..., grid_index, params, metrics) of one model for every cell and grid point.

    One row of metrics per fit comes back to the driver; data and models stay distributed. `threads` fits are under
    way at a time. A grid may name `random_features` for the kernel models, the size of their
    feature map.
    """
    is_classifier = ESTIMATORS[name][0]
    spark = long.sparkSession
    train = long.where("set = 'train'")
    facts = [f.asDict() for f in train.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("rows"), F.first(F.size("x")).alias("width"),
        F.min(draw_key("stop", F.col("sample_id"))).alias("first_draw")).collect()]
    classes: dict[tuple, list[float]] = {}
    if is_classifier:
        for r in train.select(*cell, "y").distinct().collect():  # one row per cell and class
            classes.setdefault(tuple(r[c] for c in cell), []).append(r["y"])
    scaled = scale_features(long, cell, values=sum(f["width"] for f in facts))
    scaled = scaled if is_classifier else scale_targets(scaled, cell)
    path = scratch_path(spark, "scaled")
    scaled.write.partitionBy(*cell).parquet(path)  # a fit reads the folder of its cell and nothing else
    stored = spark.read.schema(scaled.schema).parquet(path)

    def one(job):
        fact, index, point = job
        part = stored
        for c in cell:
            part = part.where(F.col(c) == F.lit(fact[c]))
        found = sorted(classes.get(tuple(fact[c] for c in cell), []))
        pred = predict(part, name, point, fact["rows"], found, fact["width"], fact["first_draw"])
        metrics = (classification_metrics if is_classifier else regression_metrics)(pred, cell).first()
        return {**metrics.asDict(), "grid_index": index, "params": {k: float(v) for k, v in point.items()}}

    jobs = [(f, i, p) for f in facts for i, p in enumerate(grid_points(grid))]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        results = list(pool.map(one, jobs))
    names = ["acc", "f1"] if is_classifier else ["r2", "mae", "mse"]
    kinds = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in cell] + ["grid_index INT", "params MAP<STRING,DOUBLE>"]
                    + [f"{m}_{s} DOUBLE" for m in names for s in ("train", "val", "test")])
    columns = [*cell, "grid_index", "params", *[f"{m}_{s}" for m in names for s in ("train", "val", "test")]]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in results], ddl)
