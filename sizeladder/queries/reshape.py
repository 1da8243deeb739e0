"""Sorting, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..operators.grids import expand_grid, route_parameters
from ..operators.select import union_scores
from .base import (BEST_ROWS, CURVE_POINTS, CURVE_RUN, SCORE_ROWS, best_rows, points, query, rounded, score_rows, stored,
                   table)
from .projections import RUNS_SQL, document_runs
from .windows import MATCHED, MATCH_CASES, matched


@query("t02_sorted_curves", "WITH " + CURVE_POINTS + """
SELECT model, features, n, round(y_mean, 10) AS y_mean FROM curve_points ORDER BY features""")
def sorted_curves(spark, sf):
    out = tables.compare_by(points(spark, sf), "features", {})
    return out.select("model", "features", "n", rounded(F.col("y_mean"), 10).alias("y_mean"))


@query("t03_nearest_control", "WITH RECURSIVE " + MATCH_CASES + """,
spread AS (SELECT var_pop(c) AS v FROM docs),
pool AS (SELECT doc_id, c, substr(md5(concat_ws(':', 'tie', doc_id)), 1, 16) AS tie FROM docs WHERE y NOT IN (SELECT y FROM minority))
SELECT a.doc_id AS case_id, arg_min(p.doc_id, {'d': (a.c - p.c) * (a.c - p.c) * (1.0 / v), 't': p.tie, 'i': p.doc_id}) AS control_id
FROM docs a, pool p, spread WHERE a.y IN (SELECT y FROM minority) GROUP BY a.doc_id""")
def nearest(spark, sf):
    """The nearest control of every minority case, with replacement."""
    from ..functions.draws import draw_key
    from ..operators.matching import inverse_spread, nearest_controls
    from .base import document_samples
    docs = stored(document_samples(spark, sf, "toxic"))
    weights = inverse_spread(docs, ["dataset"]).first()["weights"]
    cases = docs.where("y = 1").select(F.lit(0).alias("grp"), "sample_id", "c")
    pool = docs.where("y = 0").select(F.lit(0).alias("grp"), "sample_id", draw_key("tie", F.col("sample_id")).alias("tie"), "c")
    return nearest_controls(cases, pool, weights, 1).select("case_id", "control_id")


@query("t05_ordered_selection", "WITH " + BEST_ROWS + """
SELECT model, features, n, s, round(r2_val, 8) AS r2_val FROM best_rows ORDER BY n, s""")
def ordered(spark, sf):
    return (best_rows(spark, sf).orderBy("n", "s")
            .select("model", "features", "n", "s", rounded(F.col("r2_val"), 8).alias("r2_val")))


@query("u01_union_scores", "WITH " + SCORE_ROWS + """
SELECT model, n, s, grid_index, round(r2_val, 8) AS r2_val, NULL::DOUBLE AS acc_val FROM score_rows WHERE features = 'F'
UNION ALL SELECT model, n, s, grid_index, NULL, alpha / 10 FROM score_rows WHERE features <> 'F'""")
def unions(spark, sf):
    s = score_rows(spark, sf)
    key = ["model", "n", "s", "grid_index"]
    a = s.where("features = 'F'").select(*key, rounded(F.col("r2_val"), 8).alias("r2_val"))
    b = s.where("features <> 'F'").select(*key, (F.col("alpha") / 10).alias("acc_val"))
    return union_scores([a, b])


@query("u03_distinct_runs", "WITH " + RUNS_SQL + """
SELECT DISTINCT dataset, model, features, target, method, cni, balanced, quantile, grid FROM runs""")
def distinct_runs(spark, sf):
    from ..plans.experiments import canonical_runs
    return canonical_runs(document_runs(spark, sf)).select("dataset", "model", "features", "target", "method", "cni",
                                                           "balanced", "quantile", "grid")


@query("u04_cases_and_controls", MATCHED + """
SELECT n, seed, "set", count(*) AS samples FROM (SELECT n, seed, "set", case_id FROM pairs UNION ALL
SELECT n, seed, "set", control_id FROM pairs) GROUP BY n, seed, "set" """)
def cases_and_controls(spark, sf):
    splits, _ = matched(spark, sf)
    return splits.groupBy("n", "seed", "set").agg(F.count(F.lit(1)).alias("samples"))


@query("u05_union_curves", "WITH " + CURVE_POINTS + """
SELECT 'mean' AS kind, model, features, n, round(y_mean, 10) AS y FROM curve_points
UNION ALL SELECT 'score', model, features, n, round(r2_val, 10) FROM (
  SELECT model, features, n, max(r2_val) AS r2_val FROM best_rows GROUP BY model, features, n)""")
def union_curves(spark, sf):
    a = points(spark, sf).select(F.lit("mean").alias("kind"), *CURVE_RUN, "n", rounded(F.col("y_mean"), 10).alias("y"))
    b = (best_rows(spark, sf).groupBy(*CURVE_RUN, "n").agg(F.max("r2_val").alias("y"))
         .select(F.lit("score").alias("kind"), *CURVE_RUN, "n", rounded(F.col("y"), 10).alias("y")))
    return a.unionByName(b)


@query("r01_melt_hyperparameters", "WITH " + BEST_ROWS + """
SELECT model, features, s, n, round(r2_val, 8) AS r2_val, 'alpha' AS hyperparameter, alpha AS value FROM best_rows
UNION ALL SELECT model, features, s, n, round(r2_val, 8), 'l1_ratio', l1_ratio FROM best_rows""")
def melt(spark, sf):
    out = tables.hyperparameter_table(best_rows(spark, sf), ["alpha", "l1_ratio"], ["model", "features", "s"])
    return out.withColumn("r2_val", rounded(F.col("r2_val"), 8))


@query("r02_explode_curves", "WITH " + CURVE_POINTS + """
SELECT model, features, n AS x, round(y_mean, 10) AS y_mean, round(y_std, 10) AS y_std FROM curve_points""")
def explode(spark, sf):
    from ..operators.curves import statistics
    from ..sources.results import curve_documents
    docs = curve_documents(statistics(best_rows(spark, sf), CURVE_RUN, "r2_test"), CURVE_RUN, "r2_test")
    return tables.explode_curve(docs, CURVE_RUN).select(*CURVE_RUN, "x", rounded(F.col("y_mean"), 10).alias("y_mean"),
                                                        rounded(F.col("y_std"), 10).alias("y_std"))


def _line_grids(spark, sf):
    """Discounts and taxes seen per line status and return flag, as hyperparameter grids."""
    li = table(spark, sf, "lineitem")
    long = li.select("l_returnflag", "l_linestatus", F.inline(F.array(
        F.struct(F.lit("discount").alias("param"), F.col("l_discount").alias("v")),
        F.struct(F.lit("tax").alias("param"), F.col("l_tax").alias("v"))))).distinct()
    values = (long.groupBy("l_returnflag", "l_linestatus", "param")
              .agg(F.array_sort(F.collect_set("v")).alias("values")))  # about ten values each
    pairs = F.array_sort(F.collect_list(F.struct("param", "values")))
    return values.groupBy("l_returnflag", "l_linestatus").agg(F.map_from_entries(pairs).alias("params"))


@query("r03_grid_expansion", """
WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, l_discount AS discount FROM lineitem),
t AS (SELECT DISTINCT l_returnflag, l_linestatus, l_tax AS tax FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY discount, tax) - 1 AS INTEGER) AS grid_index,
       discount, tax FROM d JOIN t USING (l_returnflag, l_linestatus)""")
def grid_expansion(spark, sf):
    out = expand_grid(_line_grids(spark, sf), ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "grid_index", F.col("params")["discount"].alias("discount"),
                      F.col("params")["tax"].alias("tax"))


@query("r04_parameter_routing", "WITH " + BEST_ROWS + """
SELECT model, features, n, s, alpha AS ridge_alpha, CAST(n AS DOUBLE) AS pca_components, CAST(2 AS INTEGER) AS ridge_size FROM best_rows""")
def routing(spark, sf):
    params = F.map_from_arrays(F.array(F.lit("ridge__alpha"), F.lit("ridge__tol"), F.lit("pca__n_components")),
                               F.array(F.col("alpha"), F.lit(0.001), F.col("n").cast("double")))
    b = best_rows(spark, sf).withColumn("params", params)
    ridge, pca = route_parameters(F.col("params"), "ridge"), route_parameters(F.col("params"), "pca")
    return b.select("model", "features", "n", "s", ridge["alpha"].alias("ridge_alpha"),
                    pca["n_components"].alias("pca_components"), F.size(ridge).alias("ridge_size"))


