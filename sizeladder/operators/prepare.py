"""Raw columns to prepared role tables ``(sample_id, data, mask)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import all_finite
from ..schema import PREPARED_SCHEMA, SAMPLE

ROLES = ("features", "targets", "covariates")


def require_rows(df: DataFrame, role: str) -> None:
    """Empty data is allowed for covariates only."""
    if role != "covariates" and df.isEmpty():
        raise ValueError("Dataset is empty after loading.")


def require_covariates(covariates: DataFrame, method: str) -> None:
    """Every method but `none` needs covariates."""
    if method != "none" and covariates.isEmpty():
        raise ValueError("The correction method needs covariates, but there are none.")


def require_numeric(df: DataFrame, columns: list[str]) -> None:
    """Every data column must be numeric (or an array of numbers); decided from the schema alone."""
    for field in df.select(*columns).schema.fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise TypeError(f"Incompatible data type: {kind.simpleString()}. Numeric data is required.")


def to_matrix(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """One DOUBLE array per row from scalar columns and/or array columns, in the given order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.col(c).cast("array<double>") if isinstance(types[c], T.ArrayType)
             else F.array(F.col(c).cast("double")) for c in columns]
    data = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.select(F.col(id_col).cast("bigint").alias(SAMPLE), data.alias("data"))


def flatten_target(matrix: DataFrame) -> DataFrame:
    """n x 1 target to a scalar `y`."""
    return matrix.withColumn("y", F.col("data")[0])


def with_mask(matrix: DataFrame) -> DataFrame:
    """A row is valid when all of its values are finite."""
    return matrix.withColumn("mask", all_finite(F.col("data")))


def to_float32(df: DataFrame, column: str = "data") -> DataFrame:
    """Round the stored values to single precision."""
    return df.withColumn(column, F.transform(column, lambda v: v.cast("float").cast("double")))


def empty_covariates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PREPARED_SCHEMA)


def prepare(df: DataFrame, role: str, columns: list[str], id_col: str, quantile_transform: bool = False,
            single_precision: bool = False) -> DataFrame:
    """Check, shape, optionally transform, and mask one role of a dataset."""
    if role not in ROLES:
        raise ValueError(f"Invalid data type: {role}")
    require_numeric(df, columns)
    require_rows(df, role)
    matrix = to_matrix(df, columns, id_col)
    if quantile_transform:
        from .quantile import quantile_transform as transform
        matrix = transform(matrix)
    if single_precision:
        matrix = to_float32(matrix)
    return with_mask(matrix)


def align(*roles: DataFrame, names: tuple[str, ...] = ("x", "y", "c")) -> DataFrame:
    """Inner join of prepared roles on the sample id; masks are conjoined into `valid`."""
    renamed = [r.select(SAMPLE, F.col("data").alias(n), F.col("mask").alias(f"_mask_{n}"))
               for r, n in zip(roles, names)]
    joined = reduce(lambda a, b: a.join(b, SAMPLE), renamed)
    masks = [F.col(f"_mask_{n}") for _, n in zip(roles, names)]
    return joined.withColumn("valid", reduce(lambda a, b: a & b, masks)).drop(*[f"_mask_{n}" for n in names])


def unmatched_samples(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids present on one side only, with the side that has them."""
    a = left.select(SAMPLE, F.lit(1).alias("_l"))
    b = right.select(SAMPLE, F.lit(1).alias("_r"))
    return (a.join(b, SAMPLE, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull())
            .select(SAMPLE, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in")))


def require_aligned(left: DataFrame, right: DataFrame) -> None:
    """Both roles must describe the same samples."""
    if not unmatched_samples(left, right).isEmpty():
        raise AssertionError("Mismatch in data samples: the two roles do not cover the same sample ids")


def feature_mode(df: DataFrame, mode: str, x: str = "x", c: str = "c") -> DataFrame:
    """Model input for a feature mode; any other mode is an error."""
    choice = {"normal": F.col(x), "with-cni": F.concat(x, c), "only-cni": F.col(c)}
    if mode not in choice:
        raise ValueError(f"Invalid mode: {mode}")
    return df.withColumn(x, choice[mode])


def require_valid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail the job on the first row with a missing or infinite value; no extra pass over the data."""
    types = {f.name: f.dataType for f in df.schema.fields}
    from ..functions.numeric import is_finite
    checks = [all_finite(F.col(c)) if isinstance(types[c], T.ArrayType) else is_finite(F.col(c))
              for c in columns]
    ok = reduce(lambda a, b: a & b, checks)
    message = F.lit("A model input is missing or not finite.")
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
