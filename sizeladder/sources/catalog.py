"""Named datasets: name -> role -> variant -> loader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import empty_covariates, prepare
from .files import number_rows, read_matrix

Loader = Callable[[SparkSession], DataFrame]


class Catalog:
    """Loaders return (sample_id, data columns...); a path is read by its suffix and numbered by position."""

    def __init__(self):
        self._loaders: dict[tuple[str, str, str], Loader] = {}
        self._paths: dict[tuple[str, str, str], str] = {}

    def add(self, dataset: str, role: str, variant: str, loader: Loader | str) -> "Catalog":
        if isinstance(loader, str):
            path = loader
            self._paths[dataset, role, variant] = path

            def loader(spark, path=path):
                df = read_matrix(spark, path)
                return df if "sample_id" in df.columns else number_rows(df)
        self._loaders[dataset, role, variant] = loader
        return self

    def entries(self) -> list[tuple[str, str, str]]:
        return sorted(self._loaders)

    def missing_files(self, spark: SparkSession) -> list[str]:
        """A message for every registered path that does not exist; the paths are configuration."""
        def absent(path: str) -> bool:
            try:
                spark.read.format("binaryFile").load(path).schema
            except AnalysisException as e:
                return e.getCondition() == "PATH_NOT_FOUND"
            return False
        return [f"Dataset '{d}': {r} file '{v}' does not exist at path '{p}'."
                for (d, r, v), p in sorted(self._paths.items()) if absent(p)]

    def raw(self, spark: SparkSession, dataset: str, role: str, variant: str) -> DataFrame:
        try:
            return self._loaders[dataset, role, variant](spark)
        except KeyError:
            raise KeyError("Requested predefined dataset or variant does not exist.") from None

    def load(self, spark: SparkSession, dataset: str, role: str, variant: str,
             quantile_transform: bool = False) -> DataFrame:
        """Prepared (sample_id, data, mask)."""
        if role == "covariates" and variant == "none" and (dataset, role, variant) not in self._loaders:
            return empty_covariates(spark)
        df = self.raw(spark, dataset, role, variant)
        columns = [c for c in df.columns if c != "sample_id"]
        return prepare(df, role, columns, "sample_id", quantile_transform)

