"""Quality classifier by co-training (Blum and Mitchell, 1998).

Two logistic models look at a document through separate views: one at its text (ratios of whole-text counts and the
distribution of its bytes), one at its metadata (source, language, stated length). Labelled documents start both. In every
round each view scores a fresh part of the unlabelled documents, all of which are used over the rounds, and its most
confident ones become pseudo-labels for the other view. On labelled documents held out from fitting each view is
calibrated (Platt), and the calibrated views are combined as independent evidence to score every document.

Features are computed once for all documents and stored; rounds and scoring read only those. What goes to the driver is
bounded by parameters: `TRAIN_ROWS` labelled documents, and `PSEUDO_ROWS` per view, class and round.

Null texts count as empty; null metadata are values of their own; null ids have no label. Repeated rows get the same
score. Labels that contradict each other for a document, and null labels, are not used. Without labels of both classes
every document gets the prior (one half without any labels). Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import bounded_batches, md5_bits, text_of
from .quality_rules import text_stats

TRAIN_ROWS = 20_000
PSEUDO_ROWS = 500
ROUNDS = 4
#: Probability from which a view's opinion is confident.
CONFIDENT = 0.95
BYTE_GROUPS, SOURCE_BINS, LANG_BINS, LENGTH_BINS = 32, 32, 8, 12


def text_features(text: str) -> np.ndarray:
    n, chars, symbols, dup, repeated, lines, distinct, upper, exclaim, stops = text_stats(text)
    w, k = max(n, 1), max(lines, 1)
    ratios = [np.log1p(n), min(chars / w, 30.0), symbols / w, dup / k, repeated / w, distinct / w, upper / w,
              min(exclaim / w, 5.0), min(stops / w, 5.0), np.log1p(lines)]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8) // (256 // BYTE_GROUPS)
    return np.concatenate([ratios, np.bincount(raw, minlength=BYTE_GROUPS) / max(len(raw), 1)]).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def content_view(texts: pd.Series) -> pd.Series:
    return texts.map(text_features)


def _one_hot(place: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == place).cast("float"))


def metadata_view(source: Column, lang: Column, length: Column) -> Column:
    """Hashed source and language, and the length by powers of two; null is a value."""
    log = F.log2(F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)) + 1)
    return F.concat(
        _one_hot(F.pmod(F.xxhash64(F.coalesce(source, F.lit("~"))), F.lit(SOURCE_BINS)), SOURCE_BINS),
        _one_hot(F.pmod(F.xxhash64(F.coalesce(lang, F.lit("~"))), F.lit(LANG_BINS)), LANG_BINS),
        _one_hot(F.least(F.floor(log / 1.5), F.lit(LENGTH_BINS - 1)), LENGTH_BINS),
        F.array(log.cast("float"), length.isNull().cast("float")))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang", length_col: str = "n_chars") -> DataFrame:
    """(_id, _draw, content, metadata) per row, stored."""
    bounded_batches(docs.sparkSession)
    return store(docs.select(
        F.col(id_col).alias("_id"), md5_bits(F.lit("co"), F.col(id_col)).alias("_draw"),
        content_view(text_of(text_col)).alias("content"),
        metadata_view(F.col(source_col), F.col(lang_col), F.col(length_col)).alias("metadata")), "features")


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def column(self, view: str) -> Column:
        """The logit as a SQL expression."""
        slope = self.weights[:-1] / self.scale
        shift = float(self.weights[-1] - slope @ self.mean)
        pairs = F.zip_with(view, F.array(*[F.lit(float(s)) for s in slope]), lambda x, s: x * s)
        return F.aggregate(pairs, F.lit(shift), lambda acc, v: acc + v)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """Newton's method with a ridge penalty on all but the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weights, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (p - y) + penalty * weights
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        weights = weights - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return Logistic(mean, scale, weights)


def labelled_rows(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_label_id, y): one consistent label per id."""
    clean = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("y")).dropna()
    one = clean.groupBy("_label_id").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other")
    return one.select("_label_id", (F.col("y") > 0).cast("double").alias("y"))


@dataclass
class CoTrained:
    """Both views with their calibration (slope, intercept) and the prior logit."""

    content: Logistic
    metadata: Logistic
    calibration: dict[str, tuple[float, float]]
    prior: float

    def calibrated(self, view: str) -> Column:
        slope, intercept = self.calibration[view]
        return getattr(self, view).column(view) * slope + intercept


def _frame(rows: DataFrame) -> tuple[dict[str, np.ndarray], pd.DataFrame]:
    pdf = rows.toPandas()
    views = {v: np.stack(pdf[v].to_list()).astype(float) if len(pdf) else np.zeros((0, 1)) for v in ("content", "metadata")}
    return views, pdf


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rounds: int = ROUNDS,
          train_rows: int = TRAIN_ROWS, pseudo_rows: int = PSEUDO_ROWS) -> CoTrained | None:
    """Co-trained views, or None where the labels are not of two classes."""
    known = store(labelled_rows(rows, labels, id_col, label_col), "labels")
    n = known.count()
    chosen = known.where(md5_bits(F.lit("pick"), F.col("_label_id")) < int(min(1.0, train_rows / max(n, 1)) * 2 ** 60))
    sample, pdf = _frame(rows.join(chosen, F.col("_id") == F.col("_label_id")).select("_draw", "y", "content", "metadata")
                         .orderBy("_draw"))
    if len(pdf) == 0 or pdf["y"].nunique() < 2:
        return None
    y, held = pdf["y"].to_numpy(), pdf["_draw"].to_numpy() % 4 == 0
    for part in (held, ~held):
        if len(set(y[part])) < 2:
            held = np.zeros(len(y), dtype=bool)
    fit_on = ~held
    calibrate_on = held if held.any() else fit_on
    views = ("content", "metadata")
    other = {"content": "metadata", "metadata": "content"}
    x_train = {v: sample[v][fit_on] for v in views}
    y_train = {v: y[fit_on] for v in views}
    models = {v: fit_logistic(x_train[v], y_train[v]) for v in views}
    share = float(y[fit_on].mean())
    unknown = rows.join(known, F.col("_id") == F.col("_label_id"), "left_anti")
    for k in range(rounds):
        low, high = (2 ** 60) * k // rounds, (2 ** 60) * (k + 1) // rounds
        pool = unknown.where((F.col("_draw") >= low) & (F.col("_draw") < high))
        found = {}
        for v in views:
            scored = pool.withColumn("_logit", models[v].column(v))
            sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
            good = scored.where(F.col("_logit") >= sure).orderBy(F.desc("_logit"), "_draw").limit(
                max(1, int(2 * pseudo_rows * share)))
            bad = scored.where(F.col("_logit") <= -sure).orderBy("_logit", "_draw").limit(
                max(1, int(2 * pseudo_rows * (1 - share))))
            found[v] = _frame(good.unionByName(bad).select("content", "metadata", (F.col("_logit") > 0).cast("double").alias("y")))
        for v in views:
            seen, told = found[v]
            if len(told):
                o = other[v]
                x_train[o] = np.vstack([x_train[o], seen[o]])
                y_train[o] = np.concatenate([y_train[o], told["y"].to_numpy()])
        models = {v: fit_logistic(x_train[v], y_train[v]) for v in views}
    calibration = {}
    for v in views:
        platt = fit_logistic(models[v].logits(sample[v][calibrate_on])[:, None], y[calibrate_on], ridge=1e-3)
        slope = float(platt.weights[0] / platt.scale[0])
        calibration[v] = (slope, float(platt.weights[1] - slope * platt.mean[0]))
    prior = float(y[calibrate_on].mean())
    return CoTrained(models["content"], models["metadata"], calibration, float(np.log(prior / (1 - prior))))


def score(rows: DataFrame, model: CoTrained | None, id_col: str = "doc_id", keep: float = 0.5) -> DataFrame:
    """One row per input row: id, content_score, metadata_score, score (probabilities of good), kept."""
    def probability(logit: Column) -> Column:
        return 1 / (1 + F.exp(-logit))

    if model is None:
        half = F.lit(0.5)
        return rows.select(F.col("_id").alias(id_col), half.alias("content_score"), half.alias("metadata_score"),
                           half.alias("score"), F.lit(0.5 >= keep).alias("kept"))
    rows = rows.select("_id", model.calibrated("content").alias("_c"), model.calibrated("metadata").alias("_m"))
    both = F.col("_c") + F.col("_m") - model.prior
    return rows.select(F.col("_id").alias(id_col), probability(F.col("_c")).alias("content_score"),
                       probability(F.col("_m")).alias("metadata_score"), probability(both).alias("score"),
                       (probability(both) >= keep).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
             rounds: int = ROUNDS, keep: float = 0.5) -> DataFrame:
    """Train on the labels and score every document."""
    rows = features(docs, id_col)
    return score(rows, train(rows, labels, id_col, label_col, rounds), id_col, keep)
