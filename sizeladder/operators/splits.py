"""Train / validation / test splits for every (size, seed) at once.

`samples` is ``(run..., sample_id, y, valid)``. Sizes and seeds are configuration, so they enter as
literal arrays that are exploded; every table that is broadcast here has at most
runs x seeds x sizes x 10 classes rows, because a target with more classes is never stratified.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_key
from ..schema import MAX_CLASSES, METHODS, MIN_SET_SIZE, REGRESSION_METHODS, SAMPLE
from .ranking import kth_draw, rank_by_draw


@dataclass(frozen=True)
class Size:
    n: int
    n_val: int
    n_test: int

    @property
    def total(self) -> int:
        return self.n + self.n_val + self.n_test


def held_out_size(n: Column, frac: float, largest: int | None = None, smallest: int | None = None) -> Column:
    """Validation (= test) size for a training size: half-even rounding, then upper and lower limits."""
    size = F.bround(n.cast("double") * F.lit(frac), 0).cast("int")
    if largest:
        size = F.least(size, F.lit(int(largest)))
    if smallest:
        size = F.greatest(size, F.lit(int(smallest)))
    return size


def make_sizes(ns: list[int], frac: float = 0.25, largest: int | None = None,
               smallest: int | None = None) -> list[Size]:
    out = []
    for n in ns:
        held = round(n * frac)
        held = min(held, largest) if largest else held
        held = max(held, smallest) if smallest else held
        if n <= 1 or held <= 1:
            raise ValueError("Sample sizes must be greater than 1.")
        out.append(Size(n, held, held))
    return out


def _size_array(sizes: list[Size]) -> Column:
    return F.array(*[F.struct(F.lit(s.n).alias("n"), F.lit(s.n_val).alias("n_val"),
                              F.lit(s.n_test).alias("n_test")) for s in sizes])


def _seed_array(seeds: list[int]) -> Column:
    return F.array(*[F.lit(int(s)) for s in seeds])


DOMAIN_SKETCH = 64  # targets with a larger estimated domain are surely over the class limit of stratified splits


def class_counts(samples: DataFrame, run: list[str], only: DataFrame | None = None) -> DataFrame:
    """Rows per class, exactly and whatever their number; `only` restricts the count to some runs (one row each)."""
    if only is not None:
        samples = samples.join(F.broadcast(only.select(*run)), run)
    return samples.groupBy(*run, "y").agg(F.count(F.lit(1)).alias("cnt"))


def run_sizes(samples: DataFrame, run: list[str]) -> DataFrame:
    return samples.groupBy(*run).agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("y").alias("_about"))


def task_kind(samples: DataFrame, run: list[str], method: str, stratify: bool, balanced: bool) -> DataFrame:
    """One row per run: class count, rows, and the effective `stratify` / `balanced` flags."""
    if method not in METHODS:
        raise ValueError(f"Invalid confound correction method: {method}. Valid methods are: {', '.join(METHODS)}")
    rows = run_sizes(samples, run)
    # only the question "at most 10 classes?" matters here, so continuous targets are ruled out by a sketch
    counts = class_counts(samples, run, rows.where(F.col("_about") <= DOMAIN_SKETCH))
    classes = counts.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("cnt").alias("minority_count"),
        F.min_by("y", F.struct("cnt", "y")).alias("minority"),
        F.bool_and(F.col("y").isin(0.0, 1.0)).alias("_zero_one"))
    many = F.lit(method in REGRESSION_METHODS) | F.coalesce(F.col("n_classes") > MAX_CLASSES, F.lit(True))
    return (rows.join(F.broadcast(classes), run, "left")  # one row per run on both sides
            .withColumns({"regression": many,
                          "stratify": F.lit(True) if method == "matching" else F.lit(stratify) & ~many,
                          "balanced": F.lit(balanced) & ~many,
                          "binary": F.coalesce(F.col("_zero_one") & (F.col("n_classes") == 2), F.lit(False))})
            .drop("_zero_one", "_about"))


def undersample(drawn: DataFrame, kinds: DataFrame, run: list[str]) -> DataFrame:
    """Keep the `minority_count` smallest draws of every class where the run is balanced.

    `drawn` has (run..., seed, sample_id, y). The cut-off of each class is found first (kth_draw), so
    the data itself is filtered without a shuffle.
    """
    flags = F.broadcast(kinds.select(*run, "balanced", "minority_count"))  # one row per run
    keyed = drawn.join(flags, run).withColumn("_u", draw_key("undersample", F.col("seed"), F.col(SAMPLE)))
    group = [*run, "seed", "y"]
    cuts = kth_draw(keyed.where("balanced"), group, "_u", SAMPLE, F.col("minority_count"))
    kept = (keyed.join(F.broadcast(cuts), group, "left")
            .where(~F.col("balanced") | (F.col("_u") < F.col("cut_key"))
                   | ((F.col("_u") == F.col("cut_key")) & (F.col(SAMPLE) <= F.col("cut_tie")))))
    return kept.select(*drawn.columns)


def _apportion(counts: str, draws: str, out: str, over: Window, order_over: Window) -> list[tuple[str, Column]]:
    """Largest-remainder shares of `draws` in proportion to `counts`; ties go to the lower class."""
    total = F.sum(counts).over(over)
    exact = F.col(counts) * F.col(draws)
    return [("_floor", F.floor(exact / F.when(total == 0, F.lit(1)).otherwise(total)).cast("bigint")),
            ("_rem", exact - F.col("_floor") * total),
            ("_place", F.row_number().over(order_over)),
            ("_short", F.col(draws) - F.sum("_floor").over(over)),
            (out, F.col("_floor") + F.when(F.col("_place") <= F.col("_short"), 1).otherwise(0))]


def stratum_quotas(strata: DataFrame, run: list[str], sizes: list[Size]) -> DataFrame:
    """Rows of each stratum that go to test, validation and training.

    `strata` is (run..., seed, stratum, cnt). The test share is what remains after apportioning the
    rest; training and validation are then apportioned among what is left.
    """
    over = Window.partitionBy(*run, "seed", "n")
    place = over.orderBy(F.col("_rem").desc(), "stratum")
    df = strata.select("*", F.inline(_size_array(sizes)))
    df = df.withColumn("_keep_total", F.sum("cnt").over(over) - F.col("n_test"))
    steps = (_apportion("cnt", "_keep_total", "_keep", over, place)
             + _apportion("_keep", "n", "q_train", over, place)
             + [("_left", F.col("_keep") - F.col("q_train"))]
             + _apportion("_left", "n_val", "q_val", over, place)
             + [("q_test", F.col("cnt") - F.col("_keep"))])
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.select(*run, "seed", "stratum", "cnt", "n", "q_test", "q_val", "q_train")


def _messages(method: str) -> Column:
    """The first admissibility error of a cell, or NULL."""
    total = F.col("n") + F.col("n_val") + F.col("n_test")
    short = ((F.col("n_usable") < total) | (F.col("n_val") < MIN_SET_SIZE) | (F.col("n_test") < MIN_SET_SIZE))
    out = (F.when(F.col("n_classes") <= 1, "Only a single class in target")
           .when(short, "Insufficient samples"))
    if method == "matching":
        half = (F.floor(F.col("n") / 2) + F.floor(F.col("n_val") / 2) + F.floor(F.col("n_test") / 2))
        return (out.when(~F.col("binary"), "Matching requires binary classification")
                .when(F.col("minority_count") < half,
                      F.concat(F.lit("Insufficient samples for matching. Required: "), half.cast("string"),
                               F.lit(", Available in minority class: "), F.col("minority_count").cast("string"))))
    # the stratified sampler of the reference refuses these two; here they become error rows as well
    return (out.when(F.col("stratify") & (F.col("minority_count") < 2),
                     "The least populated class in y has only 1 member")
            .when(F.col("stratify") & (F.least("n", "n_val", "n_test") < F.col("n_classes")),
                  "Fewer samples in a set than classes"))


def split_status(kinds: DataFrame, run: list[str], sizes: list[Size], seeds: list[int], method: str) -> DataFrame:
    """One row per (run, n, seed): flags and the error that keeps the cell from being split."""
    usable = F.when(F.col("balanced"), F.col("minority_count") * F.col("n_classes")).otherwise(F.col("n_rows"))
    cells = (kinds.withColumn("n_usable", usable)
             .withColumn("seed", F.explode(_seed_array(seeds)))
             .select("*", F.inline(_size_array(sizes))))
    reported = F.floor(F.col("n") / 2) * 2 if method == "matching" else F.col("n")
    return cells.select(*run, "n", "seed", "n_val", "n_test", reported.cast("int").alias("samplesize"),
                        "stratify", "balanced", _messages(method).alias("error"))


def assign_by_rank(ranked: DataFrame, sizes: list[Size], keep: list[str]) -> DataFrame:
    """Head of the order is test, then validation, then training, for every size at once."""
    sets = (F.when(F.col("rank") <= F.col("n_test"), "test")
            .when(F.col("rank") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train"))
    return (ranked.select(*keep, SAMPLE, "rank", F.inline(_size_array(sizes)))
            .where(F.col("rank") <= F.col("n") + F.col("n_val") + F.col("n_test"))
            .select(*keep, "n", SAMPLE, sets.alias("set")))


def drawn_samples(samples: DataFrame, run: list[str], seeds: list[int], carry: tuple[str, ...] = ()) -> DataFrame:
    return samples.select(*run, SAMPLE, "y", *carry, F.explode(_seed_array(seeds)).alias("seed"))


def make_splits(samples: DataFrame, sizes: list[Size], seeds: list[int], run: list[str], method: str = "none",
                stratify: bool = False, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """Splits ``(run..., n, seed, sample_id, set)`` and their status table.

    For ``matching`` see :mod:`sizeladder.operators.matching`.
    """
    if method == "matching":
        from .matching import matched_splits
        return matched_splits(samples, sizes, seeds, run, balanced)
    usable = samples.where("valid").select(*run, SAMPLE, F.col("y").cast("double").alias("y"))
    kinds = task_kind(usable, run, method, stratify, balanced)
    status = split_status(kinds, run, sizes, seeds, method)
    drawn = drawn_samples(usable, run, seeds)
    if balanced:
        drawn = undersample(drawn, kinds, run)
    ranked_limit = max(s.total for s in sizes)
    keyed = drawn.withColumn("_key", draw_key("split", F.col("seed"), F.col(SAMPLE)))
    if stratify:
        flags = F.broadcast(kinds.select(*run, "stratify"))  # one row per run
        keyed = keyed.join(flags, run).withColumn("stratum", F.when(F.col("stratify"), F.col("y")).otherwise(0.0))
        ranked = rank_by_draw(keyed, [*run, "seed", "stratum"], "_key", SAMPLE, ranked_limit)
        strata = keyed.groupBy(*run, "seed", "stratum").agg(F.count(F.lit(1)).alias("cnt"))
        quotas = F.broadcast(stratum_quotas(strata, run, sizes))
        sets = (F.when(F.col("rank") <= F.col("q_test"), "test")
                .when(F.col("rank") <= F.col("q_test") + F.col("q_val"), "val").otherwise("train"))
        splits = (ranked.join(quotas, [*run, "seed", "stratum"])
                  .where(F.col("rank") <= F.col("q_test") + F.col("q_val") + F.col("q_train"))
                  .select(*run, "seed", "n", SAMPLE, sets.alias("set")))
    else:
        ranked = rank_by_draw(keyed, [*run, "seed"], "_key", SAMPLE, ranked_limit)
        splits = assign_by_rank(ranked, sizes, [*run, "seed"])
    good = F.broadcast(status.where("error is null").select(*run, "n", "seed"))
    return splits.join(good, [*run, "n", "seed"], "left_semi").select(*run, "n", "seed", SAMPLE, "set"), status


def sorted_indices(splits: DataFrame, run: list[str]) -> DataFrame:
    """Export form: one sorted id array per set. Group size is the configured sample size."""
    return (splits.groupBy(*run, "n", "seed").pivot("set", ["train", "val", "test"])
            .agg(F.array_sort(F.collect_list(SAMPLE))))
