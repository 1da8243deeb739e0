"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.prepare import prepare, to_matrix
from ..operators.tables import curve_table, error_bars, hyperparameter_table
from ..session import scratch_path
from ..sources import files, results
from ..sources.catalog import Catalog
from ..sources.npy import register as register_npy
from .aggregates import BOOTSTRAP
from .base import (BEST_ROWS, CURVE_POINTS, CURVE_RUN, ORDER_SPLITS, SCORE_ROWS, best_rows,
                   order_splits, points, query, rounded, score_rows, table)


@query("s01_csv_scan", "SELECT event_id, user_id, value FROM events")
def csv_scan(spark, sf):
    path = scratch_path(spark, "events") + ".csv"
    table(spark, sf, "events").select("event_id", "user_id", "value").write.option("header", True).csv(path)
    df = files.read_delimited(spark, path, columns=["event_id", "user_id", "value"])
    return df.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "value")


@query("s02_tsv_scan", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def tsv_scan(spark, sf):
    path = scratch_path(spark, "customer") + ".tsv"
    (table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
     .write.option("header", True).option("sep", "\t").csv(path))
    df = files.read_matrix(spark, path, columns=["c_custkey", "c_nationkey", "c_acctbal"])
    return df.select(F.col("c_custkey").cast("bigint"), F.col("c_nationkey").cast("int"), "c_acctbal")


@query("s03_npy_scan", """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS sample_id, CAST(len(embedding) AS INTEGER) AS width,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total
FROM embeddings""")
def npy_scan(spark, sf):
    """Shards are written by tasks in id order and read back by row range; position is the id."""
    register_npy(spark)
    path = scratch_path(spark, "vectors") + ".npy"
    (table(spark, sf, "embeddings").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
     .select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("data"))
     .write.format("npy").mode("append").save(path))
    df = files.read_matrix(spark, path)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return df.select("sample_id", F.size("data").alias("width"), rounded(F.col("data")[0]).alias("first_value"),
                     rounded(total).alias("total"))


@query("s03_npy_append", """
SELECT row_number() OVER (ORDER BY part, vec_id) - 1 AS sample_id, CAST(embedding[2] AS DOUBLE) + part AS v
FROM (SELECT *, 0 AS part FROM embeddings UNION ALL SELECT *, 1 FROM embeddings)""")
def npy_append(spark, sf):
    """A second append leaves the first one's shards and comes after them."""
    register_npy(spark)
    path = scratch_path(spark, "vectors") + ".npy"
    for part in (0, 1):
        (table(spark, sf, "embeddings").repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
         .select(F.col("vec_id").alias("sample_id"), F.array(F.element_at("embedding", 2).cast("double") + part).alias("data"))
         .write.format("npy").mode("append").save(path))
    return files.read_matrix(spark, path).select("sample_id", F.col("data")[0].alias("v"))


@query("s06_folder_rows", "SELECT o_orderkey, o_totalprice FROM orders")
def folder_rows(spark, sf):
    """Two roles written as folders of files of unequal size are numbered alike and meet row by row."""
    o, path = table(spark, sf, "orders"), scratch_path(spark, "folder")
    spread = o.repartitionByRange(5, F.sqrt(F.col("o_orderkey").cast("double"))).sortWithinPartitions("o_orderkey")
    spread.select("o_orderkey").write.parquet(path + "/key.parquet")
    spread.select("o_totalprice").write.parquet(path + "/price.parquet")
    from ..session import store
    key, price = (store(files.number_rows(files.read_matrix(spark, f"{path}/{name}.parquet"))) for name in ("key", "price"))
    return key.join(price, "sample_id").select("o_orderkey", "o_totalprice")


@query("s11_mixed_score_headers", "WITH " + BEST_ROWS + """
SELECT model, n, s, CASE WHEN model = '1-URGENT' THEN alpha END AS alpha, CASE WHEN model <> '1-URGENT' THEN l1_ratio END AS l1_ratio,
       round(r2_val, 8) AS r2_val FROM best_rows""")
def mixed_scores(spark, sf):
    """Files of different models have other columns in another order; they are read by name."""
    best, path = best_rows(spark, sf).withColumn("r2_val", rounded(F.col("r2_val"), 8)), scratch_path(spark, "mixed")
    urgent = F.col("model") == "1-URGENT"
    best.where(urgent).select("r2_val", "alpha", "s", "n", "model").write.option("header", True).csv(path + "/a")
    best.where(~urgent).select("n", "model", "l1_ratio", "s", "r2_val").write.option("header", True).csv(path + "/b")
    back = results.read_scores_csv(spark, [path + "/a", path + "/b"], "model STRING, n INT, s INT, alpha DOUBLE, l1_ratio DOUBLE, r2_val DOUBLE")
    return back.where("unreadable IS NULL").drop("unreadable")


@query("s04_parquet_scan", """
SELECT p_partkey AS sample_id, CAST(p_size AS DOUBLE) AS first_value, p_retailprice AS second_value FROM part""")
def parquet_scan(spark, sf):
    m = to_matrix(files.read_matrix(spark, f"{sf}/part.parquet"), ["p_size", "p_retailprice"], "p_partkey")
    return m.select("sample_id", F.col("data")[0].alias("first_value"), F.col("data")[1].alias("second_value"))


def _catalog(sf):
    return (Catalog()
            .add("vectors", "features", "embedding", lambda s: table(s, sf, "embeddings").select(
                F.col("vec_id").alias("sample_id"), "embedding"))
            .add("vectors", "targets", "ten-classes", lambda s: table(s, sf, "embeddings").select(
                F.col("vec_id").alias("sample_id"), "label"))
            .add("vectors", "targets", "odd-even", lambda s: table(s, sf, "embeddings").select(
                F.col("vec_id").alias("sample_id"), (F.col("label") % 2).alias("label"))))


@query("s06_dataset_catalog", """
SELECT vec_id AS sample_id, CAST(label AS DOUBLE) AS ten, CAST(label % 2 AS DOUBLE) AS odd, TRUE AS mask
FROM embeddings""")
def dataset_catalog(spark, sf):
    c = _catalog(sf)
    ten = c.load(spark, "vectors", "targets", "ten-classes")
    odd = c.load(spark, "vectors", "targets", "odd-even")
    return (ten.select("sample_id", F.col("data")[0].alias("ten"), "mask")
            .join(odd.select("sample_id", F.col("data")[0].alias("odd")), "sample_id"))


@query("s07_empty_covariates", """
SELECT label, count(*) AS samples, CAST(0 AS BIGINT) AS with_covariates FROM embeddings GROUP BY label""")
def no_covariates(spark, sf):
    c = _catalog(sf)
    none = c.load(spark, "vectors", "covariates", "none")
    y = c.load(spark, "vectors", "targets", "ten-classes").select("sample_id", F.col("data")[0].cast("int").alias("label"))
    return (y.join(none, "sample_id", "left").groupBy("label")
            .agg(F.count(F.lit(1)).alias("samples"), F.count("mask").alias("with_covariates")))


@query("s09_prepared_sink", """
SELECT c_custkey AS sample_id, round(c_acctbal, 4) AS v, TRUE AS mask, 'customers' AS dataset FROM customer
UNION ALL SELECT s_suppkey, round(s_acctbal, 4), TRUE, 'suppliers' FROM supplier""")
def prepared_sink(spark, sf):
    path = scratch_path(spark, "prepared")
    for name, key, col, dataset in (("customer", "c_custkey", "c_acctbal", "customers"),
                                    ("supplier", "s_suppkey", "s_acctbal", "suppliers")):
        p = prepare(table(spark, sf, name), "targets", [col], key)
        results.save_prepared(p, path, dataset, "targets", "balance", False)
    out = None
    for dataset in ("customers", "suppliers"):
        df = (results.load_prepared(spark, path, dataset, "targets", "balance")
              .select("sample_id", rounded(F.col("data")[0], 4).alias("v"), "mask", F.lit(dataset).alias("dataset")))
        out = df if out is None else out.unionByName(df)
    return out


@query("s10_split_sink", "WITH " + ORDER_SPLITS + """
SELECT n, seed, "set", count(*) AS rows_in_set, sum(sample_id)::BIGINT AS id_sum FROM splits GROUP BY n, seed, "set" """)
def split_sink(spark, sf):
    splits, status = order_splits(spark, sf)
    path = scratch_path(spark, "splits")
    results.save(splits, path + "/splits", ["dataset", "n"])
    results.save(status, path + "/status", ["dataset"])
    good = spark.read.parquet(path + "/status").where("error is null").select("n", "seed")
    return (spark.read.parquet(path + "/splits").join(good, ["n", "seed"], "left_semi")
            .groupBy("n", "seed", "set").agg(F.count(F.lit(1)).alias("rows_in_set"), F.sum("sample_id").alias("id_sum")))


@query("s11_score_sink_scan", "WITH " + SCORE_ROWS + """
SELECT features, n, s, grid_index, alpha, round(r2_val, 8) AS r2_val FROM score_rows WHERE model = '1-URGENT'""")
def score_sink(spark, sf):
    path = scratch_path(spark, "scores")
    results.save(score_rows(spark, sf), path, ["model", "features"])
    df = results.load(spark, path, model="1-URGENT")
    return df.select("features", "n", "s", "grid_index", "alpha", rounded(F.col("r2_val"), 8).alias("r2_val"))


@query("s12_best_score_sink", "WITH " + BEST_ROWS + """
SELECT model, features, n, s, grid_index, alpha, round(r2_val, 8) AS r2_val FROM best_rows""")
def best_sink(spark, sf):
    path = scratch_path(spark, "best")
    keep = best_rows(spark, sf).select("model", "features", "n", "s", "grid_index", "alpha",
                                       rounded(F.col("r2_val"), 8).alias("r2_val"))
    keep.write.option("header", True).csv(path)
    return results.read_scores_csv(spark, path, keep.schema.simpleString()[7:-1].replace(":", " ")).drop("unreadable")


@query("s13_curve_json_sink", BOOTSTRAP + """,
ordered AS (SELECT model, features, list(n ORDER BY n) AS x, list(round(y_mean, 10) ORDER BY n) AS y_mean, list(round(y_std, 10) ORDER BY n) AS y_std,
  list(coalesce(y_mean - y_sem > 0, FALSE) ORDER BY n) AS mask FROM curve_points GROUP BY model, features),
fitted AS (SELECT model, features FROM ok GROUP BY model, features),
boots AS (SELECT model, features, count(*) AS n_fits, round(avg(b), 3) AS b_mean, round(quantile_cont(c, 0.975), 3) AS c_975 FROM bfit GROUP BY model, features),
ys AS (SELECT model, features, list(round(m, 6) ORDER BY n) AS y_bootstrap_mean FROM (
  SELECT model, features, n, avg(y) AS m FROM resampled JOIN fitted USING (model, features) GROUP BY model, features, n) GROUP BY model, features),
seeds AS (SELECT model, features, count(DISTINCT s) AS n_seeds FROM best_rows GROUP BY model, features)
SELECT model, features, 'r2_test' AS metric, n_seeds, unnest(x) AS x, unnest(y_mean) AS y_mean, unnest(y_std) AS y_std, unnest(mask) AS mask,
       CASE WHEN n_fits > 90 THEN b_mean END AS b_mean, CASE WHEN n_fits > 90 THEN c_975 END AS c_975,
       unnest(coalesce(y_bootstrap_mean, list_transform(x, lambda v: NULL::DOUBLE))) AS y_bootstrap_mean, coalesce(n_fits, 0) AS n_fits
FROM ordered JOIN seeds USING (model, features) LEFT JOIN boots USING (model, features) LEFT JOIN ys USING (model, features)""")
def curve_json(spark, sf):
    """All fields of a curve and its list of bootstrap parameters, written and read back."""
    from ..operators.curves import statistics
    tables = statistics(best_rows(spark, sf), CURVE_RUN, "r2_test", 100)
    path = scratch_path(spark, "curves")
    results.save_json(results.curve_documents(tables, CURVE_RUN, "r2_test"), path + "/curve")
    results.save_json(results.bootstrap_documents(tables["bootstrap"], CURVE_RUN), path + "/bootstrap")
    back = results.read_json(spark, path + "/curve", "model STRING, features STRING, metric STRING, n_seeds BIGINT, x ARRAY<INT>, "
                             "y_mean ARRAY<DOUBLE>, y_std ARRAY<DOUBLE>, mask ARRAY<BOOLEAN>, p_bootstrap_mean ARRAY<DOUBLE>, "
                             "p_bootstrap_975 ARRAY<DOUBLE>, y_bootstrap_mean ARRAY<DOUBLE>")
    boots = results.read_json(spark, path + "/bootstrap", "model STRING, features STRING, bootstrap ARRAY<ARRAY<DOUBLE>>")

    flat = back.join(boots, CURVE_RUN, "left").select(
        *CURVE_RUN, "metric", "n_seeds", rounded(F.get("p_bootstrap_mean", F.lit(1)), 3).alias("b_mean"),
        rounded(F.get("p_bootstrap_975", F.lit(2)), 3).alias("c_975"), F.coalesce(F.size("bootstrap"), F.lit(0)).cast("bigint").alias("n_fits"),
        F.inline(F.arrays_zip("x", "y_mean", "y_std", "mask", "y_bootstrap_mean")))
    return flat.withColumns({"y_mean": rounded(F.col("y_mean"), 10), "y_std": rounded(F.col("y_std"), 10),
                             "y_bootstrap_mean": rounded(F.col("y_bootstrap_mean"), 6)})


@query("s14_result_discovery", "WITH " + SCORE_ROWS + """
SELECT model, features, count(*) AS stored FROM score_rows WHERE features = 'F' GROUP BY model, features""")
def discovery(spark, sf):
    """All models for fixed features: partition folders are listed and pruned, files stay unread."""
    path = scratch_path(spark, "stats")
    results.save(score_rows(spark, sf).select("model", "features", "n", "s", "r2_val"), path, ["model", "features"])
    return results.load(spark, path, features="F").groupBy("model", "features").agg(F.count(F.lit(1)).alias("stored"))


@query("s15_plot_inputs", "WITH " + CURVE_POINTS + """
SELECT 'curve' AS part, model, features, CAST(n AS DOUBLE) AS x, round(y_mean, 10) AS y, round(y_mean - y_std, 10) AS low,
       round(y_mean + y_std, 10) AS high, NULL AS name FROM curve_points
UNION ALL SELECT 'hyperparameter', model, features, CAST(n AS DOUBLE), round(alpha, 6), NULL, NULL, 'alpha' FROM best_rows""")
def plot_inputs(spark, sf):
    curve = error_bars(curve_table(points(spark, sf), CURVE_RUN)).select(
        F.lit("curve").alias("part"), *CURVE_RUN, F.col("n").cast("double").alias("x"), rounded(F.col("y"), 10).alias("y"),
        rounded(F.col("y_min"), 10).alias("low"), rounded(F.col("y_max"), 10).alias("high"),
        F.lit(None).cast("string").alias("name"))
    hps = hyperparameter_table(best_rows(spark, sf), ["alpha"], CURVE_RUN).select(
        F.lit("hyperparameter").alias("part"), *CURVE_RUN, F.col("n").cast("double").alias("x"),
        rounded(F.col("value")).alias("y"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.col("hyperparameter").alias("name"))
    return curve.unionByName(hps)


