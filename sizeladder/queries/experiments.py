"""Experiment tables: expansion, canonical form, checks and source routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import experiments as plan
from ..session import scratch_path, store
from .base import ORDER_LONG, ORDER_SEEDS, ORDER_SIZES, order_rows, query, rounded, table

# One experiment per document source; choices follow from the length of its documents.
EXPERIMENTS = """
per AS (SELECT source, sum(n_chars)::BIGINT AS k, list_sort(list(DISTINCT lang)) AS langs, list_sort(list(DISTINCT n_chars % 3)) AS rests FROM documents GROUP BY source),
experiments AS (
  SELECT source AS experiment, CASE WHEN k % 11 = 0 THEN 'unknown' ELSE 'docs' END AS dataset, langs AS features,
         ['quality', 'toxic'] AS targets,
         CASE WHEN k % 2 = 0 THEN ['none', 'correct-x', 'matching'] ELSE ['none', 'correct-y'] END AS method,
         list_concat(['none'], list_transform(rests, lambda r: 'len-' || CAST(r AS VARCHAR))) AS cni,
         CASE WHEN k % 3 = 0 THEN ['ridge-reg'] WHEN k % 3 = 1 THEN ['ridge-cls', 'ridge-reg'] ELSE ['ridge-cls', 'lasso-reg'] END AS models,
         CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 = 1 END AS balanced, CASE WHEN k % 5 = 0 THEN TRUE END AS quantile,
         CASE WHEN k % 7 = 0 THEN 'absent' WHEN k % 7 < 3 THEN 'minimal' END AS grid FROM per)"""


def experiments(spark, sf):
    d = table(spark, sf, "documents")
    per = d.groupBy("source").agg(F.sum("n_chars").alias("k"), F.array_sort(F.collect_set("lang")).alias("langs"),
                                  F.array_sort(F.collect_set((F.col("n_chars") % 3).cast("string"))).alias("rests"))
    k = F.col("k")

    def words(*w):
        return F.array(*[F.lit(x) for x in w])
    return per.select(
        F.col("source").alias("experiment"), F.when(k % 11 == 0, "unknown").otherwise("docs").alias("dataset"),
        F.col("langs").alias("features"), words("quality", "toxic").alias("targets"),
        F.when(k % 2 == 0, words("none", "correct-x", "matching")).otherwise(words("none", "correct-y")).alias("method"),
        F.concat(words("none"), F.transform("rests", lambda r: F.concat(F.lit("len-"), r))).alias("cni"),
        F.when(k % 3 == 0, words("ridge-reg")).when(k % 3 == 1, words("ridge-cls", "ridge-reg"))
        .otherwise(words("ridge-cls", "lasso-reg")).alias("models"),
        F.when(k % 4 != 0, k % 4 == 1).alias("balanced"), F.when(k % 5 == 0, True).alias("quantile"),
        F.when(k % 7 == 0, "absent").when(k % 7 < 3, "minimal").alias("grid"))


EXPANDED = EXPERIMENTS + """,
expanded AS (
  SELECT experiment, dataset, unnest(models) AS model, features, target, method, cni, balanced, quantile, grid FROM (
   SELECT *, unnest(features_) AS features FROM (SELECT * EXCLUDE (features), features AS features_ FROM (
    SELECT * EXCLUDE (targets), unnest(targets) AS target FROM (SELECT * EXCLUDE (method), unnest(method) AS method FROM (
     SELECT experiment, dataset, features, targets, method, unnest(cni) AS cni, models, coalesce(balanced, FALSE) AS balanced,
            coalesce(quantile, FALSE) AS quantile, coalesce(grid, 'default') AS grid FROM experiments))))))"""

CANONICAL = EXPANDED + """,
canonical AS (SELECT DISTINCT dataset, model, features, target, CASE WHEN method = 'none' OR cni = 'none' THEN 'none' ELSE method END AS method,
  CASE WHEN method = 'none' OR cni = 'none' THEN 'none' ELSE cni END AS cni, balanced, quantile, grid FROM expanded)"""


@query("j06_expand_experiments", "WITH " + EXPANDED + " SELECT * FROM expanded")
def expand(spark, sf):
    return plan.expand_experiments(experiments(spark, sf))


@query("j07_sizes_by_seeds", "WITH " + CANONICAL + """
SELECT dataset, model, features, target, method, cni, balanced, quantile, grid, n, seed
FROM canonical, (VALUES (128), (256), (512)) s(n), (VALUES (0), (1)) e(seed)""")
def cells(spark, sf):
    runs = plan.canonical_runs(plan.expand_experiments(experiments(spark, sf)))
    return plan.expand_cells(runs, [128, 256, 512], [0, 1])


@query("j08_canonical_runs", "WITH " + CANONICAL + " SELECT * FROM canonical")
def canonical(spark, sf):
    return plan.canonical_runs(plan.expand_experiments(experiments(spark, sf)))


# Languages with enough documents are features of the catalog; models and grids have a few entries.
REFERENCES = """
total AS (SELECT count(*) AS n FROM documents),
catalog AS (SELECT 'docs' AS dataset, 'features' AS role, lang AS name FROM documents, total GROUP BY lang, total.n HAVING count(*) > total.n / 10
  UNION ALL SELECT DISTINCT 'docs', 'covariates', 'len-' || CAST(n_chars % 2 AS VARCHAR) FROM documents
  UNION ALL SELECT DISTINCT 'docs', 'targets', CASE WHEN quality >= 0 THEN 'quality' END FROM labels),
models(model, regression) AS (VALUES ('ridge-reg', TRUE), ('ridge-cls', FALSE)),
grids(grid, model) AS (VALUES ('default', 'ridge-reg'), ('minimal', 'ridge-reg'), ('minimal', 'ridge-cls'))"""


def references(spark, sf):
    d = table(spark, sf, "documents")
    every = Window.partitionBy("dataset")  # one row per language
    langs = (d.groupBy(F.lit("docs").alias("dataset"), "lang").agg(F.count(F.lit(1)).alias("k"))
             .withColumn("total", F.sum("k").over(every)).where("k > total / 10").select(F.lit("docs").alias("dataset"), F.lit("features").alias("role"), F.col("lang").alias("name")))
    lens = d.select(F.lit("docs").alias("dataset"), F.lit("covariates").alias("role"),
                    F.concat(F.lit("len-"), (F.col("n_chars") % 2).cast("string")).alias("name")).distinct()
    targets = table(spark, sf, "labels").where("quality >= 0").select(
        F.lit("docs").alias("dataset"), F.lit("targets").alias("role"), F.lit("quality").alias("name")).distinct()
    catalog = langs.unionByName(lens).unionByName(targets)
    models = spark.createDataFrame([("ridge-reg", True), ("ridge-cls", False)], "model string, regression boolean")
    grids = spark.createDataFrame([("default", "ridge-reg"), ("minimal", "ridge-reg"), ("minimal", "ridge-cls")], "grid string, model string")
    return catalog, models, grids


REQUIRED = """
required AS (SELECT DISTINCT experiment, 'model ''' || model || ''' must be a regression model for ''' || method || '''' AS message
  FROM expanded JOIN models USING (model) WHERE NOT regression AND method IN ('correct-y', 'correct-both'))"""


@query("j11_validate_experiments", "WITH " + EXPANDED + "," + REFERENCES + "," + REQUIRED + """,
good AS (SELECT * FROM expanded WHERE dataset IN (SELECT dataset FROM catalog))
SELECT experiment, 'dataset ''' || dataset || ''' is not known' AS message FROM expanded WHERE dataset NOT IN (SELECT dataset FROM catalog)
UNION SELECT experiment, 'feature ''' || features || ''' must exist in dataset ''' || dataset || '''' FROM good
  WHERE features NOT IN (SELECT name FROM catalog WHERE role = 'features')
UNION SELECT experiment, 'target ''' || target || ''' must exist in dataset ''' || dataset || '''' FROM good
  WHERE target NOT IN (SELECT name FROM catalog WHERE role = 'targets')
UNION SELECT experiment, 'confound_correction_cni ''' || cni || ''' must exist in dataset ''' || dataset || '''' FROM good
  WHERE cni <> 'none' AND cni NOT IN (SELECT name FROM catalog WHERE role = 'covariates')
UNION SELECT experiment, 'model ''' || model || ''' is not defined' FROM expanded WHERE model NOT IN (SELECT model FROM models)
UNION SELECT experiment, 'grid ''' || grid || ''' is not defined' FROM expanded WHERE grid NOT IN (SELECT grid FROM grids)
UNION SELECT experiment, 'grid ''' || e.grid || ''' has no hyperparameters for model ''' || e.model || '''' FROM expanded e
  WHERE e.grid IN (SELECT grid FROM grids) AND NOT EXISTS (SELECT 1 FROM grids g WHERE g.grid = e.grid AND g.model = e.model)
UNION SELECT * FROM required""")
def validate(spark, sf):
    return plan.validate_experiments(experiments(spark, sf), *references(spark, sf))


@query("j12_regression_required", "WITH " + EXPANDED + "," + REFERENCES + "," + REQUIRED + " SELECT * FROM required")
def required(spark, sf):
    used = experiments(spark, sf).select("experiment", "method", F.explode("models").alias("model"))
    return plan.regression_required(used, references(spark, sf)[1]).distinct()


@query("j13_source_routing", "WITH " + CANONICAL + """
SELECT dataset, model, features, target, method, cni, balanced, quantile, grid,
       CASE WHEN method IN ('correct-x', 'correct-both') THEN cni ELSE 'none' END AS features_variant,
       CASE WHEN method IN ('correct-y', 'correct-both') THEN cni ELSE 'none' END AS targets_variant FROM canonical""")
def routing(spark, sf):
    return plan.route_sources(plan.canonical_runs(plan.expand_experiments(experiments(spark, sf))))


# one standardised feature, as it is and after its linear part in the covariate is taken out of the whole table
EXPERIMENT = "WITH " + ORDER_LONG + """,
line AS (SELECT covar_pop(lines, c_price) / var_pop(c_price) AS slope, avg(lines) AS ml, avg(c_price) AS mc FROM order_rows),
roles_ AS (SELECT 'none' AS method, n, seed, sample_id, "set", lines AS x, y FROM long
  UNION ALL SELECT 'correct-x', n, seed, sample_id, "set", lines - ml - slope * (c_price - mc), y FROM long, line),
grid(grid_index, alpha) AS (VALUES (0, 0.1), (1, 100.0)),
moments AS (SELECT method, n, seed, avg(x) AS m, stddev_pop(x) AS s, avg(y) AS my, count(*) AS k, covar_pop(x, y) AS cxy
            FROM roles_ WHERE "set" = 'train' GROUP BY method, n, seed),
pred AS (SELECT method, n, seed, grid_index, alpha, "set", y, my + k * cxy / s / (k + alpha) * (x - m) / s AS yhat
         FROM roles_ JOIN moments USING (method, n, seed), grid),
per AS (SELECT method, n, seed, grid_index, any_value(CAST(alpha AS DOUBLE)) AS alpha, "set", 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2
        FROM pred GROUP BY method, n, seed, grid_index, "set"),
sets AS (SELECT n, seed, count(*) AS drawn, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM long GROUP BY n, seed)
SELECT method, 'ridge-reg' AS model, n, seed AS s, grid_index, any_value(alpha) AS alpha, n AS samplesize, any_value(drawn) AS drawn, any_value(id_sum) AS id_sum,
       round(max(r2) FILTER ("set" = 'train'), 6) AS r2_train, round(max(r2) FILTER ("set" = 'val'), 6) AS r2_val, round(max(r2) FILTER ("set" = 'test'), 6) AS r2_test
FROM per JOIN sets USING (n, seed) GROUP BY method, n, seed, grid_index"""


@query("e02_run_experiments", EXPERIMENT)
def experiment_run(spark, sf):
    """From a catalog and experiments to stored scores; a first call leaves one alpha, the second adds the missing one."""
    from ..plans.pipeline import run_experiments
    from ..sources.catalog import Catalog
    rows, path = store(order_rows(spark, sf)), scratch_path(spark, "experiments")
    catalog = Catalog()
    for role, name, column in (("features", "lines", "lines"), ("targets", "charge", "y"), ("covariates", "price", "c_price")):
        catalog.add("orders", role, name, lambda s, c=column: rows.select("sample_id", c))
    e = spark.createDataFrame(
        [("one", "orders", ["lines"], ["charge"], ["none", "correct-x"], ["price"], ["ridge-reg"], None, None, None)],
        "experiment STRING, dataset STRING, features ARRAY<STRING>, targets ARRAY<STRING>, method ARRAY<STRING>, cni ARRAY<STRING>, "
        "models ARRAY<STRING>, balanced BOOLEAN, quantile BOOLEAN, grid STRING")
    for alphas in ([0.1], [0.1, 100.0]):
        run_experiments(spark, catalog, e, ORDER_SIZES, ORDER_SEEDS, path, grids={"default": {"ridge-reg": {"alpha": alphas}}})
    scores = spark.read.option("mergeSchema", True).parquet(path + "/scores")
    sets = (spark.read.parquet(path + "/splits").groupBy("method", "n", F.col("seed").alias("s"))
            .agg(F.count(F.lit(1)).alias("drawn"), F.sum("sample_id").alias("id_sum")))
    return scores.join(sets, ["method", "n", "s"]).select(
        "method", "model", "n", "s", "grid_index", F.col("params")["alpha"].alias("alpha"), "samplesize", "drawn", "id_sum",
        *[rounded(F.col(f"r2_{k}")).alias(f"r2_{k}") for k in ("train", "val", "test")])
