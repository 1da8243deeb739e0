"""A whole set of experiments: from a catalog and experiment definitions to stored curves.

Runs that differ in their data are numbered, and every step is one Spark job for all of them: samples, splits, drawn rows and
their inputs, and curves of all runs at once, scores of all runs of a model at once. The driver only walks through the
configuration, by ways of drawing splits and by models. Prepared and corrected roles and splits are shared by all runs that
need them, and scores that are already stored are not computed again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.confounds import regress_out, source_variant
from ..operators.curves import statistics
from ..operators.prepare import align, require_aligned, require_covariates, require_valid
from ..operators.select import select_best
from ..operators.splits import Size, make_splits
from ..schema import RUN_KEY, SAMPLE
from ..session import scratch_scope, store
from ..sources.catalog import Catalog
from .experiments import canonical_runs, expand_experiments, validate_experiments
from .grids import GRIDS
from .models import MODELS
from .sweep import BROADCAST_IDS, split_rows, sweep

# the requested balancing is part of the key as `balance`; `balanced` in the status table is what was applied
CURVE_KEY = ["balance" if k == "balanced" else k for k in RUN_KEY]
SPLIT_KEY = [k for k in CURVE_KEY if k not in ("model", "grid")]
GROUP = "_group"  # number of a split key


class Workspace:
    """Roles and samples of one catalog.

    Prepared roles are read where they are; only derived ones (corrected or transformed) are stored. Samples hold the
    target, covariates and validity; features join them after the splits are drawn, for the drawn rows alone.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self._roles, self._aligned = spark, catalog, {}, set()

    def role(self, dataset: str, role: str, name: str, quantile: bool, cni: str = "none") -> DataFrame:
        key = (dataset, role, name, quantile, cni)
        if key not in self._roles:
            if cni == "none":
                df = self.catalog.load(self.spark, dataset, role, name, quantile)
                self._roles[key] = store(df, "role") if quantile else df
            else:
                self._roles[key] = store(regress_out(self.role(dataset, role, name, quantile),
                                                     self.role(dataset, "covariates", cni, quantile)), "role")
        return self._roles[key]

    def check_aligned(self, run: dict) -> None:
        """All roles of a run must cover the same samples; ids are compared once per pair of roles."""
        names = [("features", run["features"]), ("targets", run["target"])]
        names += [("covariates", run["cni"])] if run["method"] != "none" else []
        for other in names[1:]:
            pair = (run["dataset"], names[0], other)
            if pair not in self._aligned:
                require_aligned(*[self.role(run["dataset"], r, n, False) for r, n in (names[0], other)])
                self._aligned.add(pair)

    def samples(self, run: dict) -> tuple[DataFrame, DataFrame]:
        """(sample_id, y, c, valid) of one run, c without entries where it has no covariates, and its features (sample_id, x)."""
        dataset, quantile, method, cni = run["dataset"], run["quantile"], run["method"], run["cni"]
        features = self.role(dataset, "features", run["features"], quantile, source_variant(method, "features", cni))
        roles = [features, self.role(dataset, "targets", run["target"], quantile, source_variant(method, "targets", cni))]
        names = ["x", "y"]
        if method != "none":
            covariates = self.role(dataset, "covariates", cni, quantile)
            require_covariates(covariates, method)
            roles.append(covariates)
            names.append("c")
        self.check_aligned(run)
        rows = align(*roles, names=tuple(names))
        c = F.col("c") if "c" in names else F.array()
        narrow = rows.select(F.col(SAMPLE).cast("bigint").alias(SAMPLE), F.col("y")[0].cast("double").alias("y"), c.cast("array<double>").alias("c"), "valid")
        return narrow, features.select(F.col(SAMPLE).cast("bigint").alias(SAMPLE), F.col("data").cast("array<double>").alias("x"))


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gather_drawn(samples: DataFrame, features: DataFrame, splits: DataFrame, modes: DataFrame, rows: int) -> DataFrame:
    """Model input (group, n, seed, sample_id, set, x, y) of the drawn samples, checked for missing and infinite values.

    `samples` is (group, sample_id, y, c), `features` (group, sample_id, x), `modes` (group, mode) with one row per group.
    """
    key = [GROUP, SAMPLE]
    ids = splits.select(*key).distinct()
    ids = F.broadcast(ids) if rows <= BROADCAST_IDS else ids
    drawn = features.join(ids, key, "left_semi").join(samples.select(*key, "y", "c").join(ids, key, "left_semi"), key)
    x = F.when(F.col("mode") == "only-cni", F.col("c")).when(F.col("mode") == "with-cni", F.concat("x", "c")).otherwise(F.col("x"))
    drawn = drawn.join(F.broadcast(modes), GROUP).select(*key, x.alias("x"), "y")
    return require_valid((F.broadcast(splits) if rows <= BROADCAST_IDS else splits).join(drawn, key), ["x", "y"])


def stored(spark: SparkSession, path: str, name: str, runs: DataFrame) -> DataFrame | None:
    """Rows of a stored table that belong to the numbered runs, with their number, or None where nothing was stored yet."""
    try:
        df = spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    kinds = {f.name: f.dataType for f in runs.schema.fields}  # folder names come back as text or numbers
    for k in SPLIT_KEY:
        df = df.withColumn(k, F.col(k).cast(kinds[k]))
    return df.join(F.broadcast(runs), SPLIT_KEY).drop(*SPLIT_KEY)  # one row per run


def check_configuration(spark: SparkSession, catalog: Catalog, experiments: DataFrame, grids: dict, grid: str) -> None:
    """All violations of the experiments and all missing files in one error, before anything is computed."""
    table = spark.createDataFrame(catalog.entries(), "dataset STRING, role STRING, name STRING")
    models = spark.createDataFrame([(m.name, m.regression) for m in MODELS.values()], "model STRING, regression BOOLEAN")
    known = spark.createDataFrame([(g, m) for g, by_model in grids.items() for m in by_model], "grid STRING, model STRING")
    found = validate_experiments(experiments, table, models, known, grid).orderBy("experiment", "message").collect()
    problems = [f"{r['experiment']}: {r['message']}" for r in found] + catalog.missing_files(spark)
    if problems:
        raise ValueError("Invalid configuration:\n" + "\n".join(problems))


def run_experiments(spark: SparkSession, catalog: Catalog, experiments: DataFrame, sizes: list[Size],
                    seeds: list[int], path: str, stratify: bool = False, balanced: bool = False,
                    quantile: bool = False, grid: str = "default", repeats: int = 100,
                    grids: dict | None = None) -> None:
    """Score every run and store `splits`, `status`, `scores`, `best`, and the tables of each curve below `path`.

    Sizes and seeds of earlier calls stay, and curves are drawn from all of them. Intermediate tables are removed.
    """
    grids = grids or GRIDS
    check_configuration(spark, catalog, experiments, grids, grid)
    wanted = canonical_runs(expand_experiments(experiments, balanced, quantile, grid))
    runs = [r.asDict() for r in wanted.withColumnRenamed("balanced", "balance").collect()]
    groups = list({tuple(str(r[k]) for k in SPLIT_KEY): r for r in runs}.values())  # one run per set of samples
    number = {tuple(str(r[k]) for k in SPLIT_KEY): i for i, r in enumerate(groups)}
    rows = split_rows(sizes, seeds, len(groups))
    with scratch_scope(spark):
        space = Workspace(spark, catalog)
        keys = spark.createDataFrame([(i, *[r[k] for k in SPLIT_KEY]) for i, r in enumerate(groups)], f"{GROUP} INT, " + ", ".join(
            f"{k} {'BOOLEAN' if isinstance(groups[0][k], bool) else 'STRING'}" for k in SPLIT_KEY))
        tables = [space.samples(r) for r in groups]
        tagged = lambda which: united([t[which].withColumn(GROUP, F.lit(i)) for i, t in enumerate(tables)])
        samples = store(tagged(0), "samples")
        drawn = []
        for method, balance in sorted({(r["method"], r["balance"]) for r in groups}):
            mine = [i for i, r in enumerate(groups) if (r["method"], r["balance"]) == (method, balance)]
            drawn.append(make_splits(samples.where(F.col(GROUP).isin(mine)), sizes, seeds, [GROUP], method, stratify, balance))
        splits, status = store(united([d[0] for d in drawn]), "splits"), united([d[1] for d in drawn])
        modes = keys.select(GROUP, F.col("method").alias("mode"))
        long = store(gather_drawn(samples, tagged(1), splits, modes, rows), "gathered")
        named = lambda df: df.join(F.broadcast(keys), GROUP).drop(GROUP)
        for name, df in (("splits", splits), ("status", status)):
            _save(named(_with_earlier(df, stored(spark, path, name, keys))), path, name, SPLIT_KEY)
        width = {r[GROUP]: r["d"] for r in long.groupBy(GROUP).agg(F.max(F.size("x")).alias("d")).collect()}  # one row per run
        fits: dict[tuple, list[int]] = {}
        for r in runs:
            g = number[tuple(str(r[k]) for k in SPLIT_KEY)]
            if g in width:  # else no split could be drawn, as its status says
                fits.setdefault((r["model"], r["grid"], width[g]), []).append(g)
        halved = [i for i, r in enumerate(groups) if r["method"] == "matching"]
        known = stored(spark, path, "scores", keys)
        scores: dict[bool, list[DataFrame]] = {}
        for (model, name, _), mine in sorted(fits.items()):
            found = _score(long.where(F.col(GROUP).isin(mine)), model, name, grids[name][model],
                           None if known is None else known.where((F.col("model") == model) & F.col(GROUP).isin(mine)), halved)
            scores.setdefault(MODELS[model].regression, []).append(found)
        curve = [GROUP, "model", "grid"]
        out: dict[str, list[DataFrame]] = {}
        for regression, parts in scores.items():
            best = store(select_best(united(parts), curve), "best")
            curves = statistics(best, curve, "r2_test" if regression else "acc_test", repeats)
            for name, df in {"scores": united(parts), "best": best, **curves}.items():
                out.setdefault(name, []).append(df)
        for name, parts in out.items():
            _save(named(united(parts)), path, name, CURVE_KEY)


def _score(long: DataFrame, model: str, grid_name: str, grid: dict, known: DataFrame | None, halved: list[int]) -> DataFrame:
    """Stored scores of one model for all its runs; `known` has earlier ones on any grid."""
    known = None if known is None else known.drop("model")
    scores = sweep(long, model, grid, [GROUP], None if known is None else known.drop("grid", "samplesize"))
    reported = F.when(F.col(GROUP).isin(halved), F.floor(F.col("n") / 2) * 2).otherwise(F.col("n"))
    scores = scores.withColumn("samplesize", reported.cast("int"))
    if known is not None:
        cells = long.select(GROUP, "n", F.col("seed").alias("s")).distinct()
        earlier = known.where(F.col("grid") == F.lit(grid_name)).drop("grid").join(F.broadcast(cells), [GROUP, "n", "s"], "left_anti")
        scores = scores.unionByName(earlier, allowMissingColumns=True)
    return store(scores, "scores").withColumn("model", F.lit(model)).withColumn("grid", F.lit(grid_name))


def _with_earlier(df: DataFrame, old: DataFrame | None) -> DataFrame:
    """The table with the cells of an earlier one that it does not have itself."""
    if old is None:
        return df
    cells = df.select(GROUP, "n", "seed").distinct()
    earlier = old.join(F.broadcast(cells), [GROUP, "n", "seed"], "left_anti").select(*[c for c in df.columns if c in old.columns])
    return store(df.unionByName(earlier, allowMissingColumns=True), "earlier")


def _save(df: DataFrame, path: str, name: str, key: list[str]) -> None:
    """Replace the parts of a stored table that belong to these runs; other parts stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key)
     .parquet(f"{path}/{name}"))
