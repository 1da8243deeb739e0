"""Stored tables: prepared roles, splits, scores, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, partitions: list[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def load(spark: SparkSession, path: str, **fixed) -> DataFrame:
    """A stored table restricted by partition columns; the filter prunes folders before any file is read."""
    df = spark.read.parquet(path)
    for column, value in fixed.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def save_prepared(df: DataFrame, path: str, dataset: str, role: str, variant: str, quantile: bool) -> None:
    tagged = (df.withColumn("dataset", F.lit(dataset)).withColumn("role", F.lit(role))
              .withColumn("variant", F.lit(variant)).withColumn("quantile", F.lit(quantile)))
    save(tagged, path, ["dataset", "role", "variant", "quantile"], "append")


def load_prepared(spark: SparkSession, path: str, dataset: str, role: str, variant: str,
                  quantile: bool = False) -> DataFrame:
    return load(spark, path, dataset=dataset, role=role, variant=variant,
                quantile=quantile).select("sample_id", "data", "mask")


def read_scores_csv(spark: SparkSession, paths: str | list[str], columns: str) -> DataFrame:
    """Score rows from CSV files with a header line each; columns go by name and may come in any order or be absent.

    Files are grouped by their first line, and the files of one header are one scan, so the plan grows with the number of
    headers and not of files. The tables are united by name, so files of different models can be mixed; an absent column is
    NULL. A row with a field that is not of its column's type keeps the line in `unreadable` instead of vanishing; it is NULL
    for good rows. Files without lines give no rows.
    """
    wanted = spark.createDataFrame([], columns).schema
    # lines of a file's first block come in order within their task
    lines = spark.read.text(paths, wholetext=False).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place")).where("start = 0")
    heads = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    out = None
    for r in heads.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect():  # one path per file
        raw = spark.read.option("header", True).option("quote", '"').csv(r["files"])
        cast = []
        for f in wanted.fields:
            text_value = F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None).cast("string")
            cast.append((f.name, text_value, text_value.try_cast(f.dataType)))
        bad = F.lit(False)
        for _, value, typed in cast:
            bad = bad | (value.isNotNull() & typed.isNull())
        line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns])) if raw.columns else F.lit(None).cast("string")
        part = raw.select(*[typed.alias(name) for name, _, typed in cast], F.when(bad, line).alias("unreadable"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{columns}, unreadable STRING")


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path)


def curve_documents(tables: dict[str, DataFrame], run: list[str], metric: str) -> DataFrame:
    """One JSON-ready row per curve from the tables of :func:`~sizeladder.operators.curves.statistics`.

    Arrays go by sample size, parameters by (a, b, c); what a curve is too short for is NULL.
    """
    entry = F.struct("n", "y_mean", "y_std", "y_sem", "mask")  # one entry per size
    points = tables["points"].groupBy(*run).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    p = F.col("_p")  # a field of an array of structs is the array of that field
    docs = points.select(*run, F.lit(metric).alias("metric"), p["n"].alias("x"),
                         *[p[k].alias(k) for k in ("y_mean", "y_std", "y_sem", "mask")])
    triple = F.when(F.col("a").isNotNull(), F.array("a", "b", "c"))
    docs = docs.join(tables["fit"].select(*run, "n_seeds", "dof", triple.alias("p_mean"), "r2", "chi2", "mu", "sigma"), run)
    kinds = {"mean": "mean", "std": "std", "975": "p975", "025": "p025"}
    for name, key, prefix in (("parameters", "parameter", "p_bootstrap"), ("y", "n", "y_bootstrap")):
        sums = tables[name].groupBy(*run).agg(F.array_sort(F.collect_list(F.struct(key, *kinds.values()))).alias("_b"))
        docs = docs.join(sums.select(*run, *[F.col("_b")[c].alias(f"{prefix}_{k}") for k, c in kinds.items()]), run, "left")
    return docs


def bootstrap_documents(fits: DataFrame, run: list[str]) -> DataFrame:
    """One row per curve with its list of (a, b, c), one entry per repetition."""
    fits = fits.groupBy(*run).agg(F.array_sort(F.collect_list(F.struct("rep", F.array("a", "b", "c").alias("p")))).alias("_f"))
    return fits.select(*run, F.col("_f")["p"].alias("bootstrap"))
