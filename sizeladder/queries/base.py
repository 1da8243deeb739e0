"""Query registry, and the roles that the test tables play.

Every query reads whole tables. The same roles are written once as DataFrames and once as SQL common
table expressions for the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import Size, make_sizes
from ..session import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Prepared samples and gathered splits are written once; every later step reads them several times."""
    return store(df)


def rounded(column, digits: int = 6):
    return F.round(column, digits)


# --- regression: one row per order ----------------------------------------------------------------

def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset, sample_id, qty, lines, y, c_size, c_price) per order."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return (li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("sample_id"))
            .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).cast("double").alias("lines"),
                 F.sum(charge).alias("y"), F.avg(F.col("p_size").cast("double")).alias("c_size"),
                 F.avg("p_retailprice").alias("c_price"))
            .withColumn("dataset", F.lit("orders")))


ORDER_ROWS = """
order_rows AS (
  SELECT l_orderkey AS sample_id, sum(l_quantity) AS qty, CAST(count(*) AS DOUBLE) AS lines,
         sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS y,
         avg(CAST(p_size AS DOUBLE)) AS c_size, avg(p_retailprice) AS c_price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def order_samples(spark: SparkSession, sf: str, features: tuple[str, ...] = ("qty", "lines"),
                  covariates: tuple[str, ...] = ("c_size", "c_price")) -> DataFrame:
    """(dataset, sample_id, x, y, c, valid)."""
    o = order_rows(spark, sf)
    return o.select("dataset", "sample_id", F.array(*features).alias("x"), "y",
                    F.array(*covariates).alias("c"), F.lit(True).alias("valid"))


# --- multi-class: embeddings ----------------------------------------------------------------------

def embedding_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("vectors").alias("dataset"), F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("double").alias("y"), F.lit(True).alias("valid"))


# --- binary: labelled documents with text statistics over the whole text ---------------------------

def document_samples(spark: SparkSession, sf: str, target: str = "quality") -> DataFrame:
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    t = F.col("text")
    words = F.size(F.split(t, " ")).cast("double")
    digits = F.length(F.regexp_replace(t, "[^0-9]", "")).cast("double")
    lines = F.size(F.split(t, "\n")).cast("double")
    return (d.join(labels, "doc_id")
            .select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("sample_id"),
                    F.array(F.log1p(words), F.log1p(digits), F.log1p(lines)).alias("x"),
                    F.col(target).cast("double").alias("y"),
                    F.array(F.col("n_chars").cast("double")).alias("c"), F.lit(True).alias("valid")))


# --- score rows: orders as stored results -----------------------------------------------------------

def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as one scored grid point: size by year, seed by month, unique grid position."""
    o = table(spark, sf, "orders")
    n = F.pow(F.lit(2.0), F.year("o_orderdate") - 1990).cast("int")
    wobble = (F.col("o_totalprice") % 1000) / 10000
    return o.select(
        F.lit("orders").alias("dataset"), F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("features"), n.alias("n"), F.month("o_orderdate").cast("int").alias("s"),
        F.col("o_orderkey").alias("grid_index"), (F.col("o_custkey") % 7).cast("double").alias("alpha"),
        F.nullif((F.col("o_custkey") % 5).cast("double"), F.lit(0.0)).alias("l1_ratio"),
        (F.col("o_totalprice") / 500000).alias("r2_val"),
        (F.lit(0.9) - 1.5 * F.pow(n.cast("double"), F.lit(-0.5)) + wobble).alias("r2_test"))


SCORE_ROWS = """
score_base AS (SELECT *, CAST(power(2.0, year(o_orderdate) - 1990) AS INTEGER) AS n FROM orders),
score_rows AS (
  SELECT 'orders' AS dataset, o_orderpriority AS model, o_orderstatus AS features, n,
         CAST(month(o_orderdate) AS INTEGER) AS s, o_orderkey AS grid_index,
         CAST(o_custkey % 7 AS DOUBLE) AS alpha, nullif(CAST(o_custkey % 5 AS DOUBLE), 0.0) AS l1_ratio,
         o_totalprice / 500000 AS r2_val,
         0.9 - 1.5 * power(CAST(n AS DOUBLE), -0.5) + (o_totalprice % 1000) / 10000 AS r2_test
  FROM score_base)"""

BEST_ROWS = SCORE_ROWS + """,
best_rows AS (
  SELECT * FROM score_rows
  QUALIFY row_number() OVER (PARTITION BY model, features, n, s ORDER BY r2_val DESC, grid_index) = 1)"""

CURVE_RUN = ["model", "features"]


def best_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.select import select_best
    return select_best(score_rows(spark, sf), CURVE_RUN)


CURVE_POINTS = BEST_ROWS + """,
curve_points AS (
  SELECT model, features, n, avg(r2_test) AS y_mean, stddev_samp(r2_test) AS y_std,
         stddev_samp(r2_test) / sqrt(count(r2_test)) AS y_sem
  FROM best_rows GROUP BY model, features, n)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.curves import curve_points
    return curve_points(best_rows(spark, sf), CURVE_RUN, "r2_test")


# --- configuration of the split and model queries ---------------------------------------------------

ORDER_SIZES: list[Size] = make_sizes([32, 64, 128, 256, 512])
ORDER_SEEDS = [0, 1, 2, 3, 4]
VECTOR_SIZES: list[Size] = make_sizes([64, 128, 256])
VECTOR_SEEDS = [0, 1]
RUN = ["dataset"]

SIZES_SQL = "sizes(n, n_val, n_test) AS (VALUES " + ", ".join(
    f"({s.n}, {s.n_val}, {s.n_test})" for s in ORDER_SIZES) + ")"
SEEDS_SQL = "seeds(seed) AS (VALUES " + ", ".join(f"({s})" for s in ORDER_SEEDS) + ")"
VECTOR_SIZES_SQL = "sizes(n, n_val, n_test) AS (VALUES " + ", ".join(
    f"({s.n}, {s.n_val}, {s.n_test})" for s in VECTOR_SIZES) + ")"
VECTOR_SEEDS_SQL = "seeds(seed) AS (VALUES " + ", ".join(f"({s})" for s in VECTOR_SEEDS) + ")"

ORDER_SPLITS = ORDER_ROWS + ",\n" + SIZES_SQL + ",\n" + SEEDS_SQL + """,
ranked AS (
  SELECT seed, sample_id, row_number() OVER (PARTITION BY seed ORDER BY
         substr(md5(concat_ws(':', 'split', seed, sample_id)), 1, 16), sample_id) AS rank
  FROM order_rows, seeds),
splits AS (
  SELECT n, seed, sample_id, CASE WHEN rank <= n_test THEN 'test' WHEN rank <= n_test + n_val THEN 'val'
         ELSE 'train' END AS "set"
  FROM ranked, sizes WHERE rank <= n + n_val + n_test)"""


def order_splits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.splits import make_splits
    return make_splits(stored(order_samples(spark, sf)), ORDER_SIZES, ORDER_SEEDS, RUN)


def order_long(spark: SparkSession, sf: str, features: tuple[str, ...] = ("qty", "lines"),
               mode: str = "normal") -> DataFrame:
    """Split rows with inputs and target."""
    from ..operators.splits import make_splits
    from ..plans.sweep import gather, split_rows
    samples = stored(order_samples(spark, sf, features))
    splits, _ = make_splits(samples, ORDER_SIZES, ORDER_SEEDS, RUN)
    return stored(gather(samples, splits, RUN, mode, split_rows(ORDER_SIZES, ORDER_SEEDS)))


ORDER_LONG = ORDER_SPLITS + """,
long AS (SELECT n, seed, sample_id, "set", qty, lines, y, c_size, c_price FROM splits JOIN order_rows USING (sample_id))"""


def vector_splits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.splits import make_splits
    return make_splits(embedding_samples(spark, sf), VECTOR_SIZES, VECTOR_SEEDS, RUN)


def vector_long(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans.sweep import gather
    return stored(gather(embedding_samples(spark, sf), vector_splits(spark, sf)[0], RUN))


VECTOR_LONG = VECTOR_SIZES_SQL + ",\n" + VECTOR_SEEDS_SQL + """,
vranked AS (
  SELECT seed, vec_id AS sample_id, row_number() OVER (PARTITION BY seed ORDER BY
         substr(md5(concat_ws(':', 'split', seed, vec_id)), 1, 16), vec_id) AS rank
  FROM embeddings, seeds),
long AS (
  SELECT n, seed, sample_id, CASE WHEN rank <= n_test THEN 'test' WHEN rank <= n_test + n_val THEN 'val'
         ELSE 'train' END AS "set", embedding, CAST(label AS DOUBLE) AS y
  FROM vranked JOIN embeddings ON vec_id = sample_id, sizes WHERE rank <= n + n_val + n_test)"""
