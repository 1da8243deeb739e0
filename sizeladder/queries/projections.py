"""Projections, filters and predicates (P3-P26) and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import (all_finite, clip, is_finite, log_grid, power_law, squared_distance,
                                 to_number_or_zero)
from ..operators import tables
from ..operators.confounds import regress_out
from ..operators.curves import bootstrap_fits, bootstrap_points, extrapolate_to
from ..operators.prepare import (align, feature_mode, flatten_target, require_numeric, require_rows, require_valid,
                                 to_float32, to_matrix, with_mask)
from ..operators.select import complete_columns, select_best, test_metric, union_scores, validation_metric
from ..operators.splits import held_out_size, make_sizes, split_status, task_kind
from ..sources.files import suffix_supported
from .aggregates import BOOTSTRAP, REPEATS
from .base import (BEST_ROWS, CURVE_POINTS, CURVE_RUN, ORDER_ROWS, SCORE_ROWS, best_rows, document_samples,
                   embedding_samples, order_rows, points, query, rounded, score_rows, stored, table)

# event values with some of them broken on purpose: the tables hold no NaN or infinity
BROKEN = """CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE
            WHEN event_id % 17 = 0 THEN NULL ELSE value END"""


def broken(column="value"):
    return (F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
            .when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
            .when(F.col("event_id") % 17 == 0, F.lit(None).cast("double")).otherwise(F.col(column)))


CHECKED = ["customer", "documents", "events", "labels", "orders"]


@query("p01_non_empty_check", " UNION ALL ".join(
    f"SELECT '{t}' AS name, '{r}' AS role, {empty} AND '{r}' <> 'covariates' AS refused FROM (SELECT count(*) AS k FROM {t})"
    for t in CHECKED for r, empty in (("features", "k = 0"), ("covariates", "k >= 0"))))
def non_empty(spark, sf):
    """Full tables pass; an empty one is refused unless it holds covariates."""
    rows = []
    for name in CHECKED:
        for role in ("features", "covariates"):
            df = table(spark, sf, name)
            try:
                require_rows(df if role == "features" else df.limit(0), role)
                rows.append((name, role, False))
            except ValueError:
                rows.append((name, role, True))
    return spark.createDataFrame(rows, "name string, role string, refused boolean")


NUMERIC = {"l_quantity": True, "l_shipdate": False, "l_returnflag": False, "l_linenumber": True}


@query("p02_numeric_check", " UNION ALL ".join(
    f"SELECT '{c}' AS name, {str(ok).upper()} AS accepted, count({c}) AS present FROM lineitem" for c, ok in NUMERIC.items()))
def numeric_check(spark, sf):
    """Which columns of the item table could serve as data."""
    li = table(spark, sf, "lineitem")
    verdict = {}
    for c in NUMERIC:
        try:
            require_numeric(li, [c])
            verdict[c] = True
        except TypeError:
            verdict[c] = False
    counts = li.agg(*[F.count(c).alias(c) for c in NUMERIC])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(v).alias("accepted"),
                                                     F.col(c).alias("present")) for c, v in verdict.items()])))


@query("s08_format_check", r"""
SELECT page_id, coalesce(regexp_extract(url, '(\.[A-Za-z0-9]+)/?$', 1) IN ('.csv', '.tsv', '.npy', '.parquet'), FALSE) AS supported FROM pages""")
def format_check(spark, sf):
    return table(spark, sf, "pages").select("page_id", suffix_supported(F.col("url")).alias("supported"))


@query("p03_finite_mask", f"""
SELECT event_id, coalesce(isfinite({BROKEN}), FALSE) AS mask FROM events""")
def finite_mask(spark, sf):
    return table(spark, sf, "events").select("event_id", is_finite(broken()).alias("mask"))


@query("p04_finite_rows", f"""
SELECT event_id, coalesce(isfinite({BROKEN}), FALSE) AND isfinite(value) AS mask FROM events""")
def finite_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", all_finite(F.array(broken(), "value")).alias("mask"))


@query("p05_mask_conjunction", """
SELECT event_id AS sample_id, (event_id % 11 <> 0) AND (event_id % 5 <> 0) AND (user_id % 3 <> 0) AS valid FROM events""")
def mask_conjunction(spark, sf):
    e = table(spark, sf, "events")

    def role(bad):
        return with_mask(e.select(F.col("event_id").alias("sample_id"),
                                  F.array(F.when(bad, F.lit(float("nan"))).otherwise(F.col("value"))).alias("data")))
    return align(role(F.col("event_id") % 11 == 0), role(F.col("event_id") % 5 == 0),
                 role(F.col("user_id") % 3 == 0)).select("sample_id", "valid")


@query("p06_shape_normalisation", """
SELECT c_custkey AS sample_id, CAST(1 AS INTEGER) AS width, c_acctbal AS y FROM customer""")
def shapes(spark, sf):
    m = flatten_target(to_matrix(table(spark, sf, "customer"), ["c_acctbal"], "c_custkey"))
    return m.select("sample_id", F.size("data").alias("width"), "y")


@query("p07_float32_cast", """
SELECT event_id AS sample_id, CAST(CAST(value / 3 AS FLOAT) AS DOUBLE) AS v FROM events""")
def single_precision(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 3).alias("v"))
    return to_float32(to_matrix(e, ["v"], "event_id")).select("sample_id", F.col("data")[0].alias("v"))


@query("p08_feature_modes", "WITH " + ORDER_ROWS + """
SELECT mode, sample_id, CASE mode WHEN 'with-cni' THEN 4 ELSE 2 END::INTEGER AS width,
       round(CASE mode WHEN 'only-cni' THEN c_size ELSE qty END, 4) AS first_value,
       round(CASE mode WHEN 'normal' THEN lines ELSE c_price END, 4) AS last_value
FROM order_rows, (VALUES ('normal'), ('with-cni'), ('only-cni')) m(mode)""")
def feature_modes(spark, sf):
    from .base import order_samples
    samples = order_samples(spark, sf)
    out = None
    for mode in ("normal", "with-cni", "only-cni"):
        df = feature_mode(samples, mode).select(
            F.lit(mode).alias("mode"), "sample_id", F.size("x").alias("width"),
            rounded(F.col("x")[0], 4).alias("first_value"), rounded(F.element_at("x", -1), 4).alias("last_value"))
        out = df if out is None else out.unionByName(df)
    return out


@query("p09_odd_even_target", "SELECT vec_id, CAST(label % 2 AS INTEGER) AS odd FROM embeddings")
def odd_even(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("int").alias("odd"))


@query("p10_validity_guard", """
SELECT event_id AS sample_id, value AS y FROM events WHERE event_id % 11 <> 0""")
def validity_guard(spark, sf):
    e = (table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
                                               .otherwise(F.col("value"))))
    valid = with_mask(to_matrix(e, ["v"], "event_id")).where("mask")
    return require_valid(valid, ["data"]).select("sample_id", F.col("data")[0].alias("y"))


@query("p11_validation_metric", "WITH " + SCORE_ROWS + """
SELECT model, features, n, s, grid_index, 'r2_val' AS metric, round(r2_val, 8) AS value FROM score_rows""")
def choose_validation(spark, sf):
    scores = union_scores([score_rows(spark, sf), score_rows(spark, sf).limit(0).withColumn("acc_val", F.lit(0.5))])
    metric = validation_metric(scores.columns)
    return scores.select("model", "features", "n", "s", "grid_index", F.lit(metric).alias("metric"),
                         rounded(F.col(metric), 8).alias("value"))


@query("p12_test_metric", "WITH " + BEST_ROWS + """
SELECT model, features, n, s, 'r2_test' AS metric, round(r2_test, 8) AS value FROM best_rows""")
def choose_test(spark, sf):
    best = best_rows(spark, sf)
    metric = test_metric(best.columns)
    return best.select("model", "features", "n", "s", F.lit(metric).alias("metric"), rounded(F.col(metric), 8).alias("value"))


@query("p13_complete_columns", "WITH " + BEST_ROWS + """
SELECT model, features, n, s, alpha, round(r2_val, 8) AS r2_val FROM best_rows""")
def drop_incomplete(spark, sf):
    """l1_ratio has gaps and goes away; every other column stays."""
    best = best_rows(spark, sf).select("model", "features", "n", "s", "alpha", "l1_ratio",
                                       rounded(F.col("r2_val"), 8).alias("r2_val"))
    return complete_columns(best)


@query("p14_required_columns", "WITH " + BEST_ROWS + """
SELECT 'n, s' AS columns, TRUE AS selected, count(*) AS selected_rows FROM best_rows
UNION ALL SELECT 'n', FALSE, 0 UNION ALL SELECT 's', FALSE, 0""")
def required_columns(spark, sf):
    """Without size or seed there is nothing to select."""
    scores, out = score_rows(spark, sf), None
    for columns, lacking in (("n, s", []), ("n", ["s"]), ("s", ["n"])):
        best = select_best(scores.drop(*lacking), CURVE_RUN)
        rows = (scores.limit(0) if best is None else best).agg(F.count(F.lit(1)).alias("selected_rows"))
        row = rows.select(F.lit(columns).alias("columns"), F.lit(best is not None).alias("selected"), "selected_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("p15_curve_mask", "WITH " + CURVE_POINTS + """
SELECT model, features, n, coalesce(y_mean - y_sem > 0, FALSE) AS mask FROM curve_points""")
def curve_mask(spark, sf):
    return points(spark, sf).select("model", "features", "n", "mask")


@query("p16_clip", """
SELECT event_id, CASE WHEN value > 100 THEN 100.0 WHEN value < 5 THEN 5.0 ELSE value END::DOUBLE AS v FROM (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events)""")
def clipping(spark, sf):
    v = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", clip(v, lower=5, upper=100).alias("v"))


@query("p17_number_or_zero", """
SELECT event_id, coalesce(try_cast(t AS DOUBLE), 0) AS v FROM (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS t FROM events)""")
def coerce(spark, sf):
    t = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", to_number_or_zero(t).alias("v"))


@query("p18_category_filter", "WITH " + CURVE_POINTS + """
SELECT model, features, n, round(y_mean, 10) AS y_mean FROM curve_points
WHERE model IN ('1-URGENT', '5-LOW') AND features IN ('F', 'P')""")
def category_filter(spark, sf):
    chosen = tables.filter_curves(points(spark, sf), {"model": ["1-URGENT", "5-LOW"], "features": ["F", "P"], "n": []})
    return chosen.select("model", "features", "n", rounded(F.col("y_mean"), 10).alias("y_mean"))


# documents as runs: source, language and length class stand for the key fields
RUNS_SQL = """
runs AS (
  SELECT lang AS dataset, source AS model, CASE WHEN n_chars > 1000 THEN 'long_text' ELSE 'short_text' END AS features,
         'quality' AS target, CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE 'correct-x' END AS method,
         CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE 'len_' || CAST(n_chars % 2 AS VARCHAR) END AS cni,
         n_chars % 2 = 0 AS balanced, FALSE AS quantile, 'default' AS grid, doc_id FROM documents)"""


def document_runs(spark, sf):
    d = table(spark, sf, "documents")
    plain = F.col("n_chars") % 3 == 0
    return d.select(
        F.col("lang").alias("dataset"), F.col("source").alias("model"),
        F.when(F.col("n_chars") > 1000, "long_text").otherwise("short_text").alias("features"),
        F.lit("quality").alias("target"), F.when(plain, "none").otherwise("correct-x").alias("method"),
        F.when(plain, "none").otherwise(F.concat(F.lit("len_"), (F.col("n_chars") % 2).cast("string"))).alias("cni"),
        (F.col("n_chars") % 2 == 0).alias("balanced"), F.lit(False).alias("quantile"), F.lit("default").alias("grid"),
        "doc_id")


@query("p19_confound_label", "WITH " + RUNS_SQL + " SELECT doc_id, method || '-' || cni AS confound_label FROM runs")
def label(spark, sf):
    return document_runs(spark, sf).select("doc_id", tables.confound_label().alias("confound_label"))


@query("p20_curve_id", "WITH " + RUNS_SQL + """
SELECT doc_id, concat_ws('-', dataset, features, target, model, method || '-' || cni, method, cni,
                         balanced, quantile, grid) AS id FROM runs""")
def curve_ids(spark, sf):
    runs = document_runs(spark, sf).withColumn("confound_label", tables.confound_label())
    return runs.select("doc_id", tables.curve_id().alias("id"))


@query("p21_hyphenate", "WITH " + RUNS_SQL + """
SELECT doc_id AS "doc-id", replace(features, '_', '-') AS features, replace(cni, '_', '-') AS cni FROM runs""")
def hyphens(spark, sf):
    return tables.hyphenate(document_runs(spark, sf).select("doc_id", "features", "cni"))


PATHS_SQL = RUNS_SQL.replace("'long_text'", "'long-text'").replace("'short_text'", "'short-text'").replace("'len_'", "'len-'")


def _hyphen_runs(spark, sf):
    return document_runs(spark, sf).select(
        "doc_id", "dataset", "model", *[F.translate(c, "_", "-").alias(c) for c in ("features", "target", "method", "cni")],
        "balanced", "quantile", "grid")


@query("p22_parse_run_key", "WITH " + PATHS_SQL + """
SELECT doc_id, dataset, model, features, target, method, cni, CAST(balanced AS VARCHAR) AS balanced,
       CAST(quantile AS VARCHAR) AS quantile, grid FROM runs""")
def parse_key(spark, sf):
    path = F.concat(F.lit("results/"), "dataset", F.lit("/statistics/"), "model", F.lit("/"), tables.run_key(),
                    F.lit(".stats.json"))
    runs = _hyphen_runs(spark, sf).select("doc_id", path.alias("path"))
    return runs.select("doc_id", tables.parse_run_key(F.col("path")).alias("k")).select("doc_id", "k.*")


@query("p23_format_run_key", "WITH " + PATHS_SQL + """
SELECT doc_id, concat_ws('_', features, target, method, cni, balanced, quantile, grid) AS run_key FROM runs""")
def format_key(spark, sf):
    return _hyphen_runs(spark, sf).select("doc_id", tables.run_key().alias("run_key"))


@query("p24_task_kind", """
SELECT 'vectors' AS dataset, count(*) AS n_rows, count(DISTINCT label) AS n_classes, FALSE AS regression,
       TRUE AS stratify, TRUE AS balanced FROM embeddings
UNION ALL SELECT 'events', count(*), NULL, TRUE, FALSE, FALSE FROM events""")
def kinds(spark, sf):
    """Few classes keep their flags; a continuous target switches them off."""
    v = embedding_samples(spark, sf).select("dataset", "sample_id", "y")
    e = table(spark, sf, "events").select(F.lit("events").alias("dataset"), F.col("event_id").alias("sample_id"),
                                          F.col("value").alias("y"))
    k = task_kind(v.unionByName(e), ["dataset"], "none", stratify=True, balanced=True)
    return k.select("dataset", "n_rows", "n_classes", "regression", "stratify", "balanced")


ADMISSION_SIZES = [20, 100, 1000, 100000]


@query("p25_split_admissibility", """
WITH docs AS (SELECT l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
kinds AS (
  SELECT 'quality' AS dataset, count(*) AS n_rows, count(DISTINCT quality) AS k, least(sum(quality), count(*) - sum(quality)) AS m FROM docs
  UNION ALL SELECT 'toxic', count(*), count(DISTINCT toxic), least(sum(toxic), count(*) - sum(toxic)) FROM docs
  UNION ALL SELECT 'constant', count(*), 1, count(*) FROM docs),
cells AS (SELECT *, CAST(round_even(n * 0.25, 0) AS INTEGER) AS h FROM kinds, (VALUES (20), (100), (1000), (100000)) s(n))
SELECT dataset, n, CASE WHEN k <= 1 THEN 'Only a single class in target'
  WHEN n_rows < n + 2 * h OR h < 2 THEN 'Insufficient samples'
  WHEN m < n // 2 + 2 * (h // 2) THEN 'Insufficient samples for matching. Required: ' || CAST(n // 2 + 2 * (h // 2) AS VARCHAR)
       || ', Available in minority class: ' || CAST(m AS VARCHAR) END AS error FROM cells""")
def admissibility(spark, sf):
    q = document_samples(spark, sf, "quality").withColumn("dataset", F.lit("quality"))
    t = document_samples(spark, sf, "toxic").withColumn("dataset", F.lit("toxic"))
    one = q.withColumn("dataset", F.lit("constant")).withColumn("y", F.lit(0.0))
    rows = q.unionByName(t).unionByName(one).select("dataset", "sample_id", "y")
    k = task_kind(rows, ["dataset"], "matching", True, False)
    return split_status(k, ["dataset"], make_sizes(ADMISSION_SIZES), [0], "matching").select("dataset", "n", "error")


@query("p26_held_out_size", """
SELECT o_orderkey, greatest(least(CAST(round_even(o_custkey * 0.25, 0) AS INTEGER), 200), 4)::INTEGER AS n_val FROM orders""")
def held_out(spark, sf):
    size = held_out_size(F.col("o_custkey"), 0.25, largest=200, smallest=4)
    return table(spark, sf, "orders").select("o_orderkey", size.alias("n_val"))


# --- scalar functions --------------------------------------------------------------------------------

@query("x01_power_law", """
SELECT o_orderkey, round(-1.5 * power(o_totalprice, -0.45) + 0.8, 6) AS y FROM orders""")
def power(spark, sf):
    y = power_law(F.col("o_totalprice"), F.lit(-1.5), F.lit(0.45), F.lit(0.8))
    return table(spark, sf, "orders").select("o_orderkey", rounded(y).alias("y"))


@query("x02_squared_distance", """
WITH m AS (SELECT label, list(a ORDER BY i) AS centre FROM (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: power(CAST(embedding[i] AS DOUBLE) - centre[i], 2))), 6) AS d
FROM embeddings JOIN m USING (label)""")
def distance(spark, sf):
    e = embedding_samples(spark, sf)
    centre = (e.select("y", F.posexplode("x").alias("i", "v")).groupBy("y", "i").agg(F.avg("v").alias("a")).groupBy("y")
              .agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("c")))
    joined = e.join(centre.select("y", F.col("c")["a"].alias("c")), "y")
    return joined.select(F.col("sample_id").alias("vec_id"), rounded(squared_distance(F.col("x"), F.col("c"))).alias("d"))


@query("x03_linear_residual", "WITH " + ORDER_ROWS + """,
f AS (SELECT regr_slope(y, c_price) AS b, regr_intercept(y, c_price) AS a FROM order_rows)
SELECT sample_id, round(y - (a + b * c_price), 3) + 0.0 AS residual FROM order_rows, f""")
def linear_residual(spark, sf):
    o = stored(order_rows(spark, sf))
    y = with_mask(o.select("sample_id", F.array("y").alias("data")))
    c = with_mask(o.select("sample_id", F.array("c_price").alias("data")))
    return regress_out(y, c).select("sample_id", rounded(F.col("data")[0], 3).alias("residual"))


@query("x04_log_grid", "WITH " + SCORE_ROWS + """,
top AS (SELECT model, max(n) * 64.0 AS top FROM score_rows GROUP BY model)
SELECT model, CAST(i AS INTEGER) AS i, round(power(10, log10(128) + (log10(top) - log10(128)) * i / 99.0), 4) AS n
FROM top, range(100) r(i)""")
def grid_points(spark, sf):
    top = score_rows(spark, sf).groupBy("model").agg((F.max("n") * 64.0).alias("top"))
    return (top.select("model", F.posexplode(log_grid(128, F.col("top"))).alias("i", "n"))
            .select("model", "i", rounded(F.col("n"), 4).alias("n")))


@query("x05_fit_lines", "WITH " + BEST_ROWS + """
SELECT model, features, n AS size, s, CAST(i AS INTEGER) AS i,
       round(-r2_val * power(power(10, log10(128) + (log10(100000) - log10(128)) * i / 99.0), -(alpha / 10)) + r2_test, 6) AS y
FROM best_rows, range(100) r(i) WHERE l1_ratio IS NOT NULL""")
def lines(spark, sf):
    """Best rows serve as parameter sets; those with a missing one are skipped."""
    p = best_rows(spark, sf).select("model", "features", F.col("n").alias("size"), "s", (-F.col("r2_val")).alias("a"),
                                    F.when(F.col("l1_ratio").isNotNull(), F.col("alpha") / 10).alias("b"),
                                    F.col("r2_test").alias("c"))
    out = tables.fit_lines(p, ["model", "features", "size", "s"], 100000)
    return out.select("model", "features", "size", "s", "i", rounded(F.col("y")).alias("y"))


@query("x06_curve_table", "WITH " + CURVE_POINTS + """
SELECT model, features, n, round(CASE WHEN y_mean < -1 THEN -1 ELSE y_mean END, 10) AS y,
       round(CASE WHEN coalesce(y_std, 0) > 1 THEN 1 ELSE coalesce(y_std, 0) END, 10) AS y_std FROM curve_points""")
def tidy(spark, sf):
    t = tables.curve_table(points(spark, sf), CURVE_RUN)
    return t.select("model", "features", "n", rounded(F.col("y"), 10).alias("y"), rounded(F.col("y_std"), 10).alias("y_std"))


@query("x07_hyperparameter_points", "WITH " + BEST_ROWS + """,
ranges AS (SELECT model, min(alpha) AS alpha_lo, max(alpha) AS alpha_hi, min(l1_ratio) AS l1_lo, max(l1_ratio) AS l1_hi
           FROM score_rows GROUP BY model)
SELECT model, n, s, features, 'alpha' AS hyperparameter, alpha AS value, alpha_lo AS low, alpha_hi AS high
FROM best_rows JOIN ranges USING (model)
UNION ALL SELECT model, n, s, features, 'l1_ratio', l1_ratio, l1_lo, l1_hi FROM best_rows JOIN ranges USING (model)""")
def hyperparameter_points(spark, sf):
    scores = score_rows(spark, sf)
    grids = (scores.unpivot(["model"], ["alpha", "l1_ratio"], "param", "value").distinct()
             .groupBy("model", "param").agg(F.collect_set("value").alias("values")))  # a handful of grid values
    ranges = tables.hyperparameter_ranges(grids, ["model"]).withColumnRenamed("param", "hyperparameter")
    t = tables.hyperparameter_table(best_rows(spark, sf), ["alpha", "l1_ratio"], ["model", "features", "s"])
    return t.join(ranges, ["model", "hyperparameter"]).select("model", "n", "s", "features", "hyperparameter", "value",
                                                              "low", "high")


@query("x08_compare_by", "WITH " + RUNS_SQL + """,
curves AS (SELECT *, n_chars FROM runs JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE dataset = 'en')
SELECT doc_id, cni, method, model FROM curves WHERE model = 'src1' AND (method = 'correct-x' OR (method = 'none' AND cni = 'none'))""")
def compare(spark, sf):
    runs = document_runs(spark, sf)
    return tables.compare_by(runs, "cni", {"dataset": "en", "model": "src1", "method": "correct-x"}).select(
        "doc_id", "cni", "method", "model")


@query("x09_error_bars", "WITH " + CURVE_POINTS + """
SELECT model, features, n, round(y_mean - y_std, 10) AS y_min, round(y_mean + y_std, 10) AS y_max FROM curve_points""")
def bars(spark, sf):
    t = tables.error_bars(tables.curve_table(points(spark, sf), CURVE_RUN))
    return t.select("model", "features", "n", rounded(F.col("y_min"), 10).alias("y_min"), rounded(F.col("y_max"), 10).alias("y_max"))


@query("x10_extrapolation", BOOTSTRAP + """,
wide AS (SELECT model, features, size AS n, a * power(size, -b) + c AS y FROM bfit, (VALUES (10000.0::DOUBLE), (100000.0::DOUBLE)) s(size))
SELECT model, features, n, round(avg(y), 4) AS y, round(stddev_pop(y), 4) AS y_std, round(quantile_cont(y, 0.975), 4) AS y_975,
       round(quantile_cont(y, 0.025), 4) AS y_025 FROM wide GROUP BY model, features, n""")
def extrapolation(spark, sf):
    """Expected performance at sizes that were not measured, with a 95 % interval."""
    fits = bootstrap_fits(bootstrap_points(best_rows(spark, sf), CURVE_RUN, "r2_test", REPEATS), CURVE_RUN)
    return extrapolate_to(fits, CURVE_RUN, [10_000, 100_000]).select(
        *CURVE_RUN, "n", *[rounded(F.col(c), 4).alias(c) for c in ("y", "y_std", "y_975", "y_025")])


@query("x11_json_decode", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def decode(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))
