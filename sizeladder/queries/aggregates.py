"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, tables
from ..operators.gram import chunk_of, gram, raw_products
from ..operators.metrics import classification_metrics, regression_metrics
from ..operators.prepare import to_matrix
from ..operators.quantile import distinct_values
from ..operators.scaling import feature_statistics, scale_targets, unscale_predictions
from ..operators.splits import class_counts
from .base import (BEST_ROWS, CURVE_POINTS, CURVE_RUN, ORDER_LONG, VECTOR_LONG, best_rows, order_long,
                   points, query, rounded, table, vector_long)

# --- classes ------------------------------------------------------------------------------------------


def _conversation_targets(spark, sf):
    """Turn roles, document languages and users (hundreds of classes) as class targets of three runs."""
    d = table(spark, sf, "documents").select(F.lit("lang").alias("dataset"), F.ascii("lang").cast("double").alias("y"))
    c = table(spark, sf, "conversations").select(F.lit("role").alias("dataset"), F.length("role").cast("double").alias("y"))
    u = table(spark, sf, "events").select(F.lit("user").alias("dataset"), F.col("user_id").cast("double").alias("y"))
    return d.unionByName(c).unionByName(u)


TARGETS = """
t AS (SELECT 'lang' AS dataset, CAST(ascii(lang) AS DOUBLE) AS y FROM documents
      UNION ALL SELECT 'role', CAST(length(role) AS DOUBLE) FROM conversations
      UNION ALL SELECT 'user', CAST(user_id AS DOUBLE) FROM events)"""


@query("a01_class_count", "WITH " + TARGETS + "SELECT dataset, count(DISTINCT y) AS n_classes FROM t GROUP BY dataset")
def class_count(spark, sf):
    return (class_counts(_conversation_targets(spark, sf), ["dataset"]).groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("n_classes")))


@query("a02_class_histogram", "WITH " + TARGETS + "SELECT dataset, y, count(*) AS cnt FROM t GROUP BY dataset, y")
def histogram(spark, sf):
    return class_counts(_conversation_targets(spark, sf), ["dataset"])


@query("a03_minority_class", "WITH " + TARGETS + """
SELECT dataset, arg_min(y, {'c': cnt, 'y': y}) AS minority, min(cnt) AS minority_count
FROM (SELECT dataset, y, count(*) AS cnt FROM t GROUP BY dataset, y) GROUP BY dataset""")
def minority(spark, sf):
    return (class_counts(_conversation_targets(spark, sf), ["dataset"]).groupBy("dataset")
            .agg(F.min_by("y", F.struct("cnt", "y")).alias("minority"), F.min("cnt").alias("minority_count")))


# --- curves -------------------------------------------------------------------------------------------

@query("a04_curve_moments", "WITH " + CURVE_POINTS + """
SELECT model, features, n, round(y_mean, 10) AS y_mean, round(y_std, 10) AS y_std, round(y_sem, 10) AS y_sem FROM curve_points""")
def moments(spark, sf):
    return points(spark, sf).select("model", "features", "n",
                                    *[rounded(F.col(c), 10).alias(c) for c in ("y_mean", "y_std", "y_sem")])


@query("a05_seed_count", "WITH " + BEST_ROWS + """
SELECT model, features, count(DISTINCT s) AS n_seeds FROM best_rows GROUP BY model, features""")
def seed_count(spark, sf):
    return best_rows(spark, sf).groupBy(*CURVE_RUN).agg(F.count_distinct("s").alias("n_seeds"))


@query("a06_degrees_of_freedom", "WITH " + CURVE_POINTS + """
SELECT model, features, CAST(count(*) FILTER (coalesce(y_mean - y_sem > 0, FALSE)) - 3 AS INTEGER) AS dof
FROM curve_points GROUP BY model, features""")
def dof(spark, sf):
    return curves.fit_power_law(points(spark, sf), CURVE_RUN).select(*CURVE_RUN, "dof")


# --- metrics ------------------------------------------------------------------------------------------

CLASS_PRED = "WITH " + VECTOR_LONG + """,
pred AS (SELECT n, seed, "set", y, CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS DOUBLE) AS yhat FROM long)"""


def _class_predictions(spark, sf):
    """The position of the largest coordinate, counted in tens, as the predicted class."""
    largest = F.array_position("x", F.array_max("x")) - 1
    return vector_long(spark, sf).select("n", "seed", "set", "y", (largest % 10).cast("double").alias("yhat"))


@query("a07_accuracy", CLASS_PRED + """
SELECT n, seed, round(avg(CAST(y = yhat AS DOUBLE)) FILTER ("set" = 'train'), 6) AS acc_train,
       round(avg(CAST(y = yhat AS DOUBLE)) FILTER ("set" = 'val'), 6) AS acc_val,
       round(avg(CAST(y = yhat AS DOUBLE)) FILTER ("set" = 'test'), 6) AS acc_test FROM pred GROUP BY n, seed""")
def accuracies(spark, sf):
    m = classification_metrics(_class_predictions(spark, sf), ["n", "seed"])
    return m.select("n", "seed", *[rounded(F.col(f"acc_{s}")).alias(f"acc_{s}") for s in ("train", "val", "test")])


@query("a08_weighted_f1", CLASS_PRED + """,
labels_ AS (SELECT n, seed, "set", y AS label, 1 AS support, 0 AS called, CAST(y = yhat AS INTEGER) AS tp FROM pred
  UNION ALL SELECT n, seed, "set", yhat, 0, 1, 0 FROM pred),
per AS (SELECT n, seed, "set", label, sum(support) AS support, 2.0 * sum(tp) / (sum(support) + sum(called)) AS f1
        FROM labels_ GROUP BY n, seed, "set", label),
f AS (SELECT n, seed, "set", sum(f1 * support) / sum(support) AS f1 FROM per GROUP BY n, seed, "set")
SELECT n, seed, round(max(f1) FILTER ("set" = 'train'), 6) AS f1_train, round(max(f1) FILTER ("set" = 'val'), 6) AS f1_val,
       round(max(f1) FILTER ("set" = 'test'), 6) AS f1_test FROM f GROUP BY n, seed""")
def f1(spark, sf):
    m = classification_metrics(_class_predictions(spark, sf), ["n", "seed"])
    return m.select("n", "seed", *[rounded(F.col(f"f1_{s}")).alias(f"f1_{s}") for s in ("train", "val", "test")])


REG_PRED = "WITH " + ORDER_LONG + ', pred AS (SELECT n, seed, "set", y, qty * 1500 AS yhat FROM long)'


def _regression_scores(spark, sf, metric, digits=6):
    pred = order_long(spark, sf).select("n", "seed", "set", "y", (F.col("x")[0] * 1500).alias("yhat"))
    m = regression_metrics(pred, ["n", "seed"])
    return m.select("n", "seed", *[rounded(F.col(f"{metric}_{s}"), digits).alias(f"{metric}_{s}") for s in ("train", "val", "test")])


def _per_set(expression, metric, digits=6):
    inner = f'm AS (SELECT n, seed, "set", {expression} AS v FROM pred GROUP BY n, seed, "set")'
    cols = ", ".join(f"round(max(v) FILTER (\"set\" = '{s}'), {digits}) AS {metric}_{s}" for s in ("train", "val", "test"))
    return f"{REG_PRED}, {inner} SELECT n, seed, {cols} FROM m GROUP BY n, seed"


@query("a09_r2", _per_set("1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))", "r2"))
def r2(spark, sf):
    return _regression_scores(spark, sf, "r2")


@query("a10_mae", _per_set("avg(abs(y - yhat))", "mae", 3))
def mae(spark, sf):
    return _regression_scores(spark, sf, "mae", 3)


@query("a11_mse", _per_set("avg((y - yhat) * (y - yhat)) / 1e6", "mse", 4))
def mse(spark, sf):
    m = order_long(spark, sf).select("n", "seed", "set", "y", (F.col("x")[0] * 1500).alias("yhat"))
    m = regression_metrics(m, ["n", "seed"])
    return m.select("n", "seed", *[rounded(F.col(f"mse_{s}") / 1e6, 4).alias(f"mse_{s}") for s in ("train", "val", "test")])


# --- scalers ------------------------------------------------------------------------------------------

@query("a12_scaler_statistics", "WITH " + ORDER_LONG + """
SELECT n, seed, CAST(i AS INTEGER) AS i, round(avg(v), 10) AS mean, round(stddev_pop(v), 10) AS sd FROM (
  SELECT n, seed, 0 AS i, qty AS v FROM long WHERE "set" = 'train' UNION ALL SELECT n, seed, 1, lines FROM long WHERE "set" = 'train')
GROUP BY n, seed, i""")
def scalers(spark, sf):
    s = feature_statistics(order_long(spark, sf), ["n", "seed"])
    pairs = F.posexplode(F.arrays_zip("mean", "sd")).alias("i", "p")
    return s.select("n", "seed", pairs).select("n", "seed", "i", rounded(F.col("p.mean"), 10).alias("mean"), rounded(F.col("p.sd"), 10).alias("sd"))


@query("a13_target_scaler", "WITH " + ORDER_LONG + """,
s AS (SELECT n, seed, avg(y) AS m, stddev_pop(y) AS d FROM long WHERE "set" = 'train' GROUP BY n, seed)
SELECT n, seed, sample_id, "set", round((y - m) / d, 6) + 0.0 AS y_scaled, round(y, 6) AS y_back FROM long JOIN s USING (n, seed)""")
def target_scaler(spark, sf):
    scaled = scale_targets(order_long(spark, sf), ["n", "seed"])
    back = unscale_predictions(scaled.withColumn("yhat", F.col("y_scaled")))
    return back.select("n", "seed", "sample_id", "set", rounded(F.col("y_scaled")).alias("y_scaled"),
                       rounded(F.col("yhat"), 6).alias("y_back"))


@query("a14_distinct_values", """
SELECT CAST(i AS INTEGER) AS i, count(DISTINCT v) AS n_distinct, CAST(count(v) AS BIGINT) AS n, count(DISTINCT v) > 20 AS transformed FROM (
  SELECT 0 AS i, value AS v FROM events UNION ALL SELECT 1, CAST(user_id % 7 AS DOUBLE) FROM events) GROUP BY i""")
def distinct(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", (F.col("user_id") % 7).alias("w"))
    d = distinct_values(to_matrix(e, ["value", "w"], "event_id"))
    return d.select("i", "n_distinct", "n", (F.col("n_distinct") > 20).alias("transformed"))


# --- fits and bootstrap ---------------------------------------------------------------------------------

def power_law_sql(source: str, key: str, out: str) -> str:
    """The bounded fit in SQL: `source` has (key..., n, y); the exponent is searched on the same steps."""
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"p.{k} = c.{k}" for k in keys)
    pk, ck = ", ".join(f"p.{k}" for k in keys), ", ".join(f"c.{k}" for k in keys)

    def level(name, candidates):
        return f"""{name} AS MATERIALIZED (SELECT {key}, b, slope, vbar, half, lo0, hi0, i FROM (
  SELECT {key}, b, half, lo0, hi0, i, CASE WHEN sxx > 1e-14 * svv AND svy > 0 THEN svy / sxx ELSE 0 END AS slope, vbar, syy, svy FROM (
    SELECT {ck}, c.b, c.half, c.lo0, c.hi0, c.i, sum(v * v) AS svv, sum(v * v) - sum(v) * sum(v) / count(*) AS sxx,
           sum(v * yc) AS svy, sum(yc * yc) AS syy, avg(v) AS vbar
    FROM (SELECT c.*, 1 - exp(-c.b * p.l) AS v, p.yc, {pk.replace('p.', 'p.')} FROM ({candidates}) c JOIN {out}_p p ON {on}) c
    GROUP BY {ck}, c.b, c.half, c.lo0, c.hi0, c.i))
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY syy - slope * svy, b) = 1)"""

    def at(i):
        return (f"CASE WHEN {i} <= 40 THEN 10.0::DOUBLE * ({i} / 40.0::DOUBLE) * ({i} / 40.0::DOUBLE) "
                f"ELSE 10.0::DOUBLE * power(top / 10.0::DOUBLE, ({i} - 40) / 20.0::DOUBLE) END")

    coarse = (f"SELECT {key}, {at('i')} AS b, 0.0::DOUBLE AS half, {at('greatest(i - 1, 0)')} AS lo0, {at('least(i + 1, 60)')} AS hi0, i "
              f"FROM (SELECT {key}, greatest(10.0::DOUBLE, 37.0::DOUBLE / min(l) FILTER (l > 0)) AS top FROM {out}_p GROUP BY {key}), range(61) r(i)")
    steps = [f"""{out}_p AS MATERIALIZED (SELECT {key}, n, y, ln(n / min(n) OVER w) AS l, y - avg(y) OVER w AS yc,
       min(n) OVER w AS first, avg(y) OVER w AS ybar FROM {source} WINDOW w AS (PARTITION BY {key}))""",
             level(f"{out}_0", coarse)]
    for r in range(1, 9):
        lo, hi = ("lo0", "hi0") if r == 1 else ("greatest(b - half, 0.0)", "b + half")
        steps.append(level(f"{out}_{r}", f"SELECT {key}, {lo} + ({hi} - {lo}) / 10 * i AS b, ({hi} - {lo}) / 10 AS half, "
                                         f"lo0, hi0, i FROM (SELECT {key}, b, half, lo0, hi0 FROM {out}_{r - 1}), range(11) r(i)"))
    steps.append(f"""{out} AS (SELECT {key}, -slope * power(first, b) AS a, b, ybar + slope * (1 - vbar) AS c
  FROM {out}_8 JOIN (SELECT {key}, any_value(first) AS first, any_value(ybar) AS ybar FROM {out}_p GROUP BY {key}) USING ({key}))""")
    return ",\n".join(steps)


FITTED = ("WITH " + CURVE_POINTS + """,
usable AS (SELECT model, features, CAST(n AS DOUBLE) AS n, y_mean AS y, y_sem AS e FROM curve_points WHERE y_mean - y_sem > 0
  QUALIFY count(*) OVER (PARTITION BY model, features) >= 5),
""" + power_law_sql("usable", "model, features", "fit"))


@query("a16_fit_quality", FITTED + """
SELECT model, features, CAST(count(*) - 3 AS INTEGER) AS dof, round(1 - sum(r * r) / (var_pop(y) * count(*)), 5) AS r2,
       round(sum(r * r / (e * e)) / (count(*) - 3), 4) AS chi2, round(avg(r / e), 4) AS mu, round(stddev_pop(r / e), 4) AS sigma
FROM (SELECT u.*, y - (a * power(n, -b) + c) AS r FROM usable u JOIN fit USING (model, features)) GROUP BY model, features""")
def quality(spark, sf):
    f = curves.fit_power_law(points(spark, sf), CURVE_RUN)
    return f.select(*CURVE_RUN, "dof", rounded(F.col("r2"), 5).alias("r2"),
                    *[rounded(F.col(c), 4).alias(c) for c in ("chi2", "mu", "sigma")])


REPEATS = 100

RESAMPLED = CURVE_POINTS + f""",
seeds_of AS (SELECT model, features, n, r2_test, row_number() OVER (PARTITION BY model, features, n ORDER BY s) - 1 AS idx,
             count(*) OVER (PARTITION BY model, features, n) AS m FROM best_rows),
draws AS (SELECT model, features, n, rep, i, any_value(m) AS m,
    CAST('0x' || substr(md5(concat_ws(':', 42, rep, n, i)), 1, 15) AS BIGINT) % any_value(m) AS pick
  FROM seeds_of, range(1, {REPEATS + 1}) reps(rep), LATERAL (SELECT unnest(range(m)) AS i) GROUP BY model, features, n, rep, i),
resampled AS (SELECT d.model, d.features, d.rep, d.n, avg(s.r2_test) AS y FROM draws d
  JOIN seeds_of s ON s.model = d.model AND s.features = d.features AND s.n = d.n AND s.idx = d.pick
  GROUP BY d.model, d.features, d.rep, d.n)"""

BOOTSTRAP = ("WITH " + RESAMPLED + """,
ok AS (SELECT model, features, n FROM curve_points WHERE y_mean - y_sem > 0 QUALIFY count(*) OVER (PARTITION BY model, features) >= 5),
boot AS (SELECT model, features, rep, CAST(n AS DOUBLE) AS n, y FROM resampled JOIN ok USING (model, features, n)),
""" + power_law_sql("boot", "model, features, rep", "bfit"))


def _resampled(spark, sf):
    return curves.bootstrap_points(best_rows(spark, sf), CURVE_RUN, "r2_test", REPEATS)


@query("a17_bootstrap_parameters", BOOTSTRAP + f""",
long AS (UNPIVOT (SELECT model, features, rep, a, b, c FROM bfit) ON a, b, c INTO NAME parameter VALUE v)
SELECT model, features, parameter, count(v) AS n_fits,
       CASE WHEN count(v) > {0.9 * REPEATS} THEN round(avg(v), 3) + 0.0 END AS mean,
       CASE WHEN count(v) > {0.9 * REPEATS} THEN round(quantile_cont(v, 0.975), 3) + 0.0 END AS p975,
       CASE WHEN count(v) > {0.9 * REPEATS} THEN round(quantile_cont(v, 0.025), 3) + 0.0 END AS p025
FROM long GROUP BY model, features, parameter""")
def bootstrap_parameters(spark, sf):
    s = curves.bootstrap_summary(curves.bootstrap_fits(_resampled(spark, sf), CURVE_RUN), CURVE_RUN, REPEATS)
    return s.select(*CURVE_RUN, "parameter", "n_fits", *[rounded(F.col(c), 3).alias(c) for c in ("mean", "p975", "p025")])


@query("a18_bootstrap_y", "WITH " + RESAMPLED + """,
ok AS (SELECT model, features FROM curve_points WHERE y_mean - y_sem > 0 GROUP BY model, features HAVING count(*) >= 5)
SELECT model, features, n, CASE WHEN o THEN round(avg(y), 12) END AS mean, CASE WHEN o THEN round(stddev_pop(y), 12) END AS std,
       CASE WHEN o THEN round(quantile_cont(y, 0.975), 12) END AS p975, CASE WHEN o THEN round(quantile_cont(y, 0.025), 12) END AS p025
FROM (SELECT r.*, EXISTS (SELECT 1 FROM ok WHERE ok.model = r.model AND ok.features = r.features) AS o FROM resampled r)
GROUP BY model, features, n, o""")
def bootstrap_y(spark, sf):
    s = curves.bootstrap_y_summary(_resampled(spark, sf), CURVE_RUN)
    return s.select(*CURVE_RUN, "n", *[rounded(F.col(c), 12).alias(c) for c in ("mean", "std", "p975", "p025")])


@query("a19_axis_domain", "WITH " + CURVE_POINTS + """
SELECT model, round(CAST(min(n) * 0.9 AS DOUBLE), 4) AS low, round(CAST(max(n) * 1.1 AS DOUBLE), 4) AS high FROM curve_points GROUP BY model""")
def domain(spark, sf):
    d = tables.axis_domain(points(spark, sf), ["model"])
    return d.select("model", rounded(F.col("low").cast("double"), 4).alias("low"), rounded(F.col("high").cast("double"), 4).alias("high"))


@query("a20_gram", "WITH " + ORDER_LONG + """,
v AS (SELECT n, seed, [1.0, qty, lines, y / 1000] AS r FROM long WHERE "set" = 'train')
SELECT n, seed, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(r[i] * r[j]), 3) AS g
FROM v, range(1, 5) a(i), range(1, 5) b(j) GROUP BY n, seed, i, j""")
def cross_moments(spark, sf):
    train = order_long(spark, sf).where("set = 'train'").withColumn("y", F.col("y") / 1000)
    g = raw_products(gram(train, ["n", "seed"], ["x", "y"], *chunk_of(F.col("n"))), ["n", "seed"])
    return g.select("n", "seed", "i", F.posexplode("row").alias("j", "g")).select("n", "seed", "i", "j", rounded(F.col("g"), 3).alias("g"))




@query("f03_metric_registry", REG_PRED + """
SELECT n, seed, "set", round(max(abs(y - yhat)), 4) AS max_error, round(avg(abs(y - yhat)), 3) AS mae FROM pred GROUP BY n, seed, "set" """)
def own_metric(spark, sf):
    """A metric added by the user next to a built-in one."""
    from ..operators.metrics import evaluate
    from ..operators.metrics import mae as built_in
    pred = order_long(spark, sf).select("n", "seed", "set", "y", (F.col("x")[0] * 1500).alias("yhat"))
    own = {"max_error": lambda: F.max(F.abs(F.col("y") - F.col("yhat"))), "mae": built_in}
    return evaluate(pred, ["n", "seed"], own).select("n", "seed", "set", rounded(F.col("max_error"), 4).alias("max_error"),
                                                     rounded(F.col("mae"), 3).alias("mae"))
