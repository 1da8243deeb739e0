"""Joins (J1-J3, J5, J9, J10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from ..operators.curves import bootstrap_fits, bootstrap_points
from ..operators.prepare import align, unmatched_samples, with_mask
from ..operators.splits import drawn_samples, task_kind, undersample
from ..plans.incremental import plan_points, split_points
from .base import (BEST_ROWS, CURVE_POINTS, CURVE_RUN, ORDER_LONG, ORDER_ROWS, RUN, best_rows, order_long, order_rows,
                   points, query, rounded, stored, table)
from .projections import RUNS_SQL, document_runs


@query("j01_align_roles", "WITH " + ORDER_ROWS + """
SELECT sample_id, CAST(2 AS INTEGER) AS features, round(y, 6) AS y, round(c_size, 4) AS c_size, lines <> 3 AS valid FROM order_rows""")
def align_roles(spark, sf):
    """Features, targets and covariates of the same samples; some features are not finite."""
    o = stored(order_rows(spark, sf))
    lines = F.when(F.col("lines") == 3, F.lit(float("inf"))).otherwise(F.col("lines"))
    x = with_mask(o.select("sample_id", F.array("qty", lines).alias("data")))
    y = with_mask(o.select("sample_id", F.array("y").alias("data")))
    c = with_mask(o.select("sample_id", F.array("c_size").alias("data")))
    return align(x, y, c).select("sample_id", F.size("x").alias("features"), rounded(F.col("y")[0]).alias("y"),
                                 rounded(F.col("c")[0], 4).alias("c_size"), "valid")


@query("j01_unmatched_samples", """
SELECT sample_id, CASE WHEN l IS NULL THEN 'right' ELSE 'left' END AS only_in FROM (
  SELECT coalesce(o_orderkey, l_orderkey) AS sample_id, o_orderkey AS l, l_orderkey AS r
  FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey) WHERE l IS NULL OR r IS NULL""")
def unmatched(spark, sf):
    """Orders without items and items without an order."""
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_id")).distinct()
    return unmatched_samples(a, b)


@query("j02_gather_split", "WITH " + ORDER_LONG + """
SELECT n, seed, sample_id, "set", qty, lines, round(y, 6) AS y FROM long""")
def gather_split(spark, sf):
    long = order_long(spark, sf)
    return long.select("n", "seed", "sample_id", "set", F.col("x")[0].alias("qty"), F.col("x")[1].alias("lines"),
                       rounded(F.col("y")).alias("y"))


REMOVED = """
q AS (SELECT doc_id, quality AS y FROM labels),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY substr(md5(concat_ws(':', 'undersample', 0, doc_id)), 1, 16), doc_id) AS r FROM q),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM q GROUP BY y))"""


@query("j03_not_sampled", "WITH " + REMOVED + " SELECT doc_id AS sample_id FROM r, m WHERE r > m")
def not_sampled(spark, sf):
    """Rows that balancing leaves out."""
    rows = table(spark, sf, "labels").select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("sample_id"),
                                             F.col("quality").cast("double").alias("y"))
    kept = undersample(drawn_samples(rows, RUN, [0]), task_kind(rows, RUN, "none", False, True), RUN)
    return rows.join(kept, "sample_id", "left_anti").select("sample_id")


@query("u02_id_difference", "WITH " + REMOVED + " SELECT doc_id AS sample_id FROM r, m WHERE r > m")
def id_difference(spark, sf):
    rows = table(spark, sf, "labels").select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("sample_id"),
                                             F.col("quality").cast("double").alias("y"))
    kept = undersample(drawn_samples(rows, RUN, [0]), task_kind(rows, RUN, "none", False, True), RUN)
    return rows.select("sample_id").exceptAll(kept.select("sample_id"))


GRID = {"alpha": [0.0, 2.0, 4.0, 6.0, 100.0]}

REUSE = "WITH " + BEST_ROWS + """,
cells AS (SELECT DISTINCT model, features, n, s FROM best_rows),
wanted AS (SELECT *, CAST(i AS INTEGER) AS grid_index, [0.0, 2.0, 4.0, 6.0, 100.0][i + 1]::DOUBLE AS alpha FROM cells, range(5) r(i)),
stored AS (SELECT model, features, n, s, alpha, r2_val FROM score_rows
  QUALIFY row_number() OVER (PARTITION BY model, features, n, s, alpha ORDER BY grid_index) = 1)"""


def _existing(spark, sf):
    from .base import score_rows
    existing = score_rows(spark, sf).select("model", "features", "n", "s", "grid_index", "r2_val",
                                            F.create_map(F.lit("alpha"), F.col("alpha")).alias("params"))
    cells = best_rows(spark, sf).select("model", "features", "n", "s").distinct()
    return plan_points(cells, GRID), existing


@query("j05_reuse_scores", REUSE + """
SELECT w.model, w.features, w.n, w.s, w.grid_index, w.alpha, round(s.r2_val, 8) AS r2_val
FROM wanted w JOIN stored s ON w.model = s.model AND w.features = s.features AND w.n = s.n AND w.s = s.s AND w.alpha = s.alpha""")
def reuse(spark, sf):
    """Grid points that are already scored, the first stored row of each."""
    reused, _ = split_points(*_existing(spark, sf), CURVE_RUN)
    return reused.select("model", "features", "n", "s", "grid_index", F.col("params")["alpha"].alias("alpha"),
                         rounded(F.col("r2_val"), 8).alias("r2_val"))


@query("i01_pending_scores", REUSE + """
SELECT w.model, w.features, w.n, w.s, w.grid_index, w.alpha FROM wanted w ANTI JOIN stored s
ON w.model = s.model AND w.features = s.features AND w.n = s.n AND w.s = s.s AND w.alpha = s.alpha""")
def pending(spark, sf):
    """Grid points that still have to be fitted."""
    _, todo = split_points(*_existing(spark, sf), CURVE_RUN)
    return todo.select("model", "features", "n", "s", "grid_index", F.col("params")["alpha"].alias("alpha"))


@query("t04_first_match", REUSE + " SELECT model, features, n, s, alpha, round(r2_val, 8) AS r2_val FROM stored")
def first_match(spark, sf):
    from ..operators.grids import first_match as first
    from .base import score_rows
    out = first(score_rows(spark, sf), ["model", "features", "n", "s", "alpha"], ["grid_index"])
    return out.select("model", "features", "n", "s", "alpha", rounded(F.col("r2_val"), 8).alias("r2_val"))


@query("j09_attach_baseline", "WITH " + RUNS_SQL + """
SELECT doc_id, method, cni FROM runs WHERE method = 'correct-x' UNION ALL
SELECT doc_id, method, cni FROM runs WHERE method = 'none' AND cni = 'none'""")
def baseline(spark, sf):
    return tables.attach_baseline(document_runs(spark, sf), "correct-x").select("doc_id", "method", "cni")


@query("j10_curve_bootstrap", "WITH " + CURVE_POINTS + """,
short AS (SELECT model, features, count(*) FILTER (coalesce(y_mean - y_sem > 0, FALSE)) >= 5 AND features <> 'P' AS has FROM curve_points GROUP BY model, features)
SELECT model, features, n, CAST(rep AS INTEGER) AS rep, rep IS NOT NULL AS fitted FROM curve_points JOIN short USING (model, features)
  LEFT JOIN range(1, 101) r(rep) ON has""")
def curve_bootstrap(spark, sf):
    """Curves keep their rows when they have no bootstrap fits."""
    sample = bootstrap_points(best_rows(spark, sf), CURVE_RUN, "r2_test", 100).where("features <> 'P'")
    fits = bootstrap_fits(sample, CURVE_RUN)
    out = tables.attach_bootstrap(points(spark, sf).select(*CURVE_RUN, "n"), fits, CURVE_RUN)
    return out.select(*CURVE_RUN, "n", "rep", F.col("c").isNotNull().alias("fitted"))
