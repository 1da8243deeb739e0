"""Matrix files by suffix."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .npy import register as register_npy

FORMATS = (".csv", ".tsv", ".npy", ".parquet")


def suffix_of(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix not in FORMATS:
        raise ValueError("Unsupported file format. Supported formats are CSV, TSV, NPY and Parquet.")
    return suffix


def suffix_supported(path: Column) -> Column:
    """The same check for a column of paths."""
    return F.coalesce(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)/?$", 1).isin(*FORMATS), F.lit(False))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None,
                   header: bool = True) -> DataFrame:
    """Delimited text with a header line; with `columns` given every one is read as DOUBLE, without a pass
    over the data to infer types."""
    reader = spark.read.option("sep", sep).option("header", header)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.DoubleType()) for c in columns]))
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """Any supported file as a table."""
    suffix = suffix_of(path)
    if suffix in (".csv", ".tsv"):
        return read_delimited(spark, path, "," if suffix == ".csv" else "\t", columns, header)
    if suffix == ".npy":
        register_npy(spark)
        return spark.read.format("npy").load(path)
    return spark.read.parquet(path)


def number_rows(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Row position as the id, for tables that carry none.

    Parquet rows are numbered by file name and place in the file, however the scan orders its tasks: a count per
    file gives each file's first number. Text has no such place, so only a single text file is numbered, by the order in
    which it is read.
    """
    files = df.inputFiles()
    if files and all(f.endswith(".parquet") for f in files):
        place = df.select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.row_index").alias("_row"))
        return _numbered(place, df.columns, id_col)
    if len(files) > 1:
        raise ValueError(f"Rows of {len(files)} text files have no order; give them a column {id_col}.")
    inside = F.lit((1 << 33) - 1)  # fixed value: the generated id holds the partition above bit 33
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    numbered = (marked.withColumn("_part", F.shiftright("_id", 33))
                .withColumn("_row", F.col("_id").bitwiseAND(inside)).drop("_id"))
    return _numbered(numbered, df.columns, id_col)


def _numbered(place: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file or partition
    starts = (place.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint"))).drop("_rows"))
    return place.join(starts, "_part").select((F.col("_start") + F.col("_row")).alias(id_col), *columns)
