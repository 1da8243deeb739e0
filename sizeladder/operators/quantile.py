"""Quantile transform to a uniform distribution, exact at any size.

The knots of a feature are order statistics. They are found by counting, without moving values: a pass over the rows counts, in
every task, the values that fall into equal slices of the brackets in which wanted ranks are known to lie; the sums say which
slice holds which rank, and those are the brackets of the next pass. Slices are cut in an order-preserving integer form of
doubles, so a bracket ends as a single value or holds so few rows that its values are fetched. What is shuffled per pass is
one number per slice and task, bounded by the knots and never by the rows. Values are then interpolated between the knots row by row.

Data of very many features is reduced to distinct values with counts instead, range-partitioned by (feature, value), so that no
feature is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_finite
from ..schema import QUANTILE_DISTINCT, QUANTILE_KNOTS, SAMPLE
from ..session import materialise, store

CHUNK_ROWS = 500_000
BROADCAST_FEATURES = 4_000  # features whose knots (8 kB each) are sent to every task
COUNTERS = 4_000_000  # slices that a task counts (32 MB)
FETCHED_ROWS = 128  # rows of a bracket whose values are fetched


def value_counts(matrix: DataFrame) -> DataFrame:
    """Distinct present values per feature with their counts: (i, v, cnt)."""
    return (matrix.select(F.posexplode("data").alias("i", "v")).where(is_finite(F.col("v")))
            .groupBy("i", "v").agg(F.count(F.lit(1)).alias("cnt")))


def distinct_values(matrix: DataFrame) -> DataFrame:
    """Distinct values per feature: (i, n_distinct, n)."""
    return value_counts(matrix).groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("cnt").alias("n"))


def ranked_values(counts: DataFrame) -> DataFrame:
    """(i, v, cnt, below): number of rows of the feature with a smaller value."""
    parts = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialise(counts.repartitionByRange(int(parts), "i", "v"))
    placed = ranged.withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("i").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("i", "_part").agg(F.sum("cnt").alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint"))))
    inside = Window.partitionBy("i", "_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("_in", F.coalesce(F.sum("cnt").over(inside), F.lit(0).cast("bigint")))
            .join(starts.drop("_rows"), ["i", "_part"])
            .select("i", "v", "cnt", (F.col("_start") + F.col("_in")).alias("below")))


def knots(counts: DataFrame, most: int = QUANTILE_KNOTS) -> DataFrame:
    """(i, k, q): percentile k of K-1 steps per feature, K = min(most, rows of the feature).

    A distinct value covers a run of ranks, and so a run of knots that integer arithmetic finds.
    """
    sizes = counts.groupBy("i").agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    sizes = sizes.where(F.col("n_distinct") > QUANTILE_DISTINCT).withColumn("_k", F.least(F.lit(most), "n") - 1)
    values = ranked_values(counts).join(F.broadcast(sizes), "i")  # one row per feature
    n, k = F.col("n") - 1, F.col("_k")

    def covered(low, high):
        first = F.greatest(F.floor((low * k + n - 1) / n).cast("bigint"), F.lit(0).cast("bigint"))
        last = F.floor((high * k + n - 1) / n).cast("bigint") - 1
        return F.when(last >= first, F.sequence(first, F.least(last, k.cast("bigint"))))

    lo, hi = F.col("below"), F.col("below") + F.col("cnt")
    lower = values.select("i", "v", "n", "_k", F.explode(covered(lo, hi)).alias("k"))
    upper = values.select("i", F.col("v").alias("v2"), F.explode(covered(lo - 1, hi - 1)).alias("k"))
    frac = ((F.col("k") * n) % k) / k
    return (lower.join(upper, ["i", "k"], "left")
            .select("i", F.col("k").cast("int").alias("k"),
                    (F.col("v") + F.when(frac > 0, frac * (F.col("v2") - F.col("v"))).otherwise(0.0)).alias("q")))


# --- knots by counting -------------------------------------------------------------------------------------------

def ordered_keys(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; -0 equals 0."""
    bits = (v + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def from_keys(key: np.ndarray) -> np.ndarray:
    bits = (key ^ np.uint64(1 << 63)).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))).view(np.float64)


def _columns_of(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x features in double; a null matrix entry is NaN."""
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def feature_facts(matrix: DataFrame) -> DataFrame:
    """(i, n, low, high, several): present values per feature, their range, and whether more than QUANTILE_DISTINCT differ."""
    most = QUANTILE_DISTINCT + 1

    def facts(batches):
        n = low = high = None
        seen: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _columns_of(batch)
            ok = np.isfinite(m)
            if n is None:
                d = m.shape[1]
                n, low, high, seen = np.zeros(d, dtype=np.int64), np.full(d, np.inf), np.full(d, -np.inf), [np.zeros(0)] * d
            n += ok.sum(axis=0)
            low = np.minimum(low, np.where(ok, m, np.inf).min(axis=0))
            high = np.maximum(high, np.where(ok, m, -np.inf).max(axis=0))
            for i in np.flatnonzero([len(s) < most for s in seen]):
                seen[i] = np.unique(np.concatenate([seen[i], m[ok[:, i], i] + 0.0]))[:most]
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(low), pa.array(high),
                                              pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))], names=["i", "n", "low", "high", "seen"])

    parts = store(matrix.select("data").mapInArrow(facts, "i INT, n BIGINT, low DOUBLE, high DOUBLE, seen ARRAY<DOUBLE>"), "facts")
    different = parts.select("i", F.explode("seen").alias("v")).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    return (parts.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            .join(different, "i").select("i", "n", "low", "high", (F.col("distinct") > QUANTILE_DISTINCT).alias("several")))


class _Search:
    """Brackets of one feature: rows below, rows inside, least and greatest key, for ranks that are still unknown."""

    def __init__(self, n: int, low: float, high: float, most: int):
        steps = min(most, n) - 1
        self.n, k = n, np.arange(steps + 1, dtype=object)
        place = k * (n - 1)
        self.lower = np.array([p // steps for p in place], dtype=np.int64)
        self.share = np.array([(p % steps) / steps for p in place], dtype=float)
        self.ranks = np.unique(np.concatenate([self.lower, np.minimum(self.lower + 1, n - 1)]))
        self.value = np.full(len(self.ranks), np.nan)
        ends = ordered_keys(np.array([low, high]))
        self.below, self.inside, self.first, self.last = (np.array([v], dtype=t) for v, t in ((0, np.int64), (n, np.int64), (ends[0], np.uint64), (ends[1], np.uint64)))
        self.settle()

    def settle(self) -> None:
        """Brackets of a single key are known; those without a wanted rank are dropped."""
        unknown = np.isnan(self.value)
        at = np.searchsorted(self.below, self.ranks[unknown], side="right") - 1
        single = self.first == self.last
        known = np.flatnonzero(unknown)[single[at]]
        self.value[known] = from_keys(self.first[at[single[at]]])
        keep = np.unique(at[~single[at]])
        self.below, self.inside, self.first, self.last = (v[keep] for v in (self.below, self.inside, self.first, self.last))

    def large(self) -> bool:
        return bool((self.inside > FETCHED_ROWS).any())

    def width(self, slices: int) -> np.ndarray:
        return (self.last - self.first) // np.uint64(slices) + np.uint64(1)

    def narrow(self, slices: int, bracket: np.ndarray, part: np.ndarray, count: np.ndarray) -> None:
        """Take the slices that hold wanted ranks as the new brackets."""
        order = np.lexsort((part, bracket))
        bracket, part, count = bracket[order], part[order].astype(np.uint64), count[order]
        run = np.cumsum(count) - count
        start = np.r_[True, bracket[1:] != bracket[:-1]]
        run = run - np.repeat(run[start], np.diff(np.r_[np.flatnonzero(start), len(run)]))
        width = self.width(slices)[bracket]
        self.below, self.inside, self.first, self.last = (
            self.below[bracket] + run, count, self.first[bracket] + part * width,
            np.minimum(self.first[bracket] + part * width + (width - np.uint64(1)), self.last[bracket]))
        self.settle()

    def knots(self) -> np.ndarray:
        at = np.searchsorted(self.ranks, self.lower)
        low, high = self.value[at], self.value[np.minimum(at + 1, len(self.ranks) - 1)]
        return low + np.where(self.share > 0, self.share * (high - low), 0.0)


def _inside(search, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the values within brackets, and their brackets."""
    key = ordered_keys(column[np.isfinite(column)])
    at = np.searchsorted(search.first, key, side="right") - 1
    ok = (at >= 0) & (key <= search.last[np.maximum(at, 0)])
    return key[ok], at[ok]


def _count_slices(matrix: DataFrame, open_: dict[int, _Search], slices: int) -> DataFrame:
    """(i, bracket, part, count) over all tasks."""
    def count(batches):
        held = {i: np.zeros(len(s.first) * slices, dtype=np.int64) for i, s in open_.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _columns_of(batch)
            for i, s in open_.items():
                key, at = _inside(s, m[:, i])
                part = ((key - s.first[at]) // s.width(slices)[at]).astype(np.int64)
                held[i] += np.bincount(at * slices + part, minlength=len(held[i]))
        for i, c in held.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, dtype=np.int32)), pa.array((some // slices).astype(np.int32)),
                                              pa.array((some % slices).astype(np.int32)), pa.array(c[some])], names=["i", "bracket", "part", "cnt"])

    rows = matrix.select("data").mapInArrow(count, "i INT, bracket INT, part INT, cnt BIGINT")
    return rows.groupBy("i", "bracket", "part").agg(F.sum("cnt").alias("cnt"))


def _fetch(matrix: DataFrame, open_: dict[int, _Search]) -> DataFrame:
    """(i, rank, v) of all wanted ranks in brackets of few rows."""
    def values(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _columns_of(batch)
            for i, s in open_.items():
                key, at = _inside(s, m[:, i])
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, dtype=np.int32)), pa.array(at.astype(np.int32)),
                                                      pa.array(from_keys(key))], names=["i", "bracket", "v"])

    def pick(key, table):
        i = key[0].as_py()
        s, at, v = open_[i], table.column("bracket").to_numpy(), table.column("v").to_numpy()
        order = np.lexsort((v, at))
        v, starts = v[order], np.searchsorted(at[order], np.arange(len(s.first)))
        ranks = s.ranks[np.isnan(s.value)]
        bracket = np.searchsorted(s.below, ranks, side="right") - 1
        found = v[starts[bracket] + ranks - s.below[bracket]]
        return pa.Table.from_arrays([pa.array([i] * len(ranks), pa.int32()), pa.array(ranks), pa.array(found)], names=["i", "rank", "v"])

    # a feature brings at most FETCHED_ROWS values per wanted rank together
    return matrix.select("data").mapInArrow(values, "i INT, bracket INT, v DOUBLE").groupBy("i").applyInArrow(pick, "i INT, rank BIGINT, v DOUBLE")


def counted_knots(matrix: DataFrame, most: int = QUANTILE_KNOTS) -> dict[int, np.ndarray]:
    """Knots by feature, for the features with more than QUANTILE_DISTINCT values; the same numbers as :func:`knots`."""
    facts = feature_facts(matrix).where("several").collect()  # one row per feature
    searches = {r["i"]: _Search(r["n"], r["low"], r["high"], most) for r in facts}
    while open_ := {i: s for i, s in searches.items() if len(s.first) and s.large()}:
        slices = int(min(65_536, max(4, COUNTERS // sum(len(s.first) for s in open_.values()))))
        found = _count_slices(matrix, open_, slices).toPandas()  # slices with rows: bounded by COUNTERS, or by four per bracket
        for i, part in found.groupby("i"):
            open_[i].narrow(slices, part["bracket"].to_numpy(), part["part"].to_numpy(), part["cnt"].to_numpy())
    if rest := {i: s for i, s in searches.items() if len(s.first)}:
        for i, part in _fetch(matrix, rest).toPandas().groupby("i"):
            rest[i].value[np.searchsorted(rest[i].ranks, part["rank"].to_numpy())] = part["v"].to_numpy()
    return {i: s.knots() for i, s in searches.items()}


def interpolate(values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Position of values among the knots: the mean of interpolating from the left and from the right."""
    ref = np.linspace(0.0, 1.0, len(q))
    out = np.full(values.shape, np.nan)
    ok = np.isfinite(values)
    out[~ok] = values[~ok]
    v = values[ok]
    got = 0.5 * (np.interp(v, q, ref) - np.interp(-v, -q[::-1], -ref[::-1]))
    got[v == q[-1]] = 1.0
    got[v == q[0]] = 0.0
    out[ok] = got
    return out


def quantile_transform(matrix: DataFrame, most: int = QUANTILE_KNOTS) -> DataFrame:
    """Transform every feature with more than 20 distinct values; others stay as they are."""
    first = matrix.select(F.size("data").alias("d")).first()
    if first and first["d"] > BROADCAST_FEATURES:
        points = (knots(value_counts(matrix), most).groupBy("i")
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q")))
        return _transform_long(matrix, materialise(points))  # at most `most` numbers per feature
    table = counted_knots(matrix, most)
    shared = matrix.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def transform(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return rows
        m = np.stack(rows.to_numpy()).astype(float)
        for i, q in shared.value.items():
            m[:, i] = interpolate(m[:, i], q)
        return pd.Series(list(m))

    return matrix.withColumn("data", transform("data"))


def _transform_long(matrix: DataFrame, points: DataFrame) -> DataFrame:
    """Very wide data: one row per value; each chunk of a feature meets the knots of that feature."""
    chunks = max(1, -(-matrix.count() // CHUNK_ROWS))
    long = (matrix.select(SAMPLE, F.posexplode("data").alias("i", "v"))
            .withColumn("_chunk", F.pmod(F.xxhash64(SAMPLE), F.lit(chunks)).cast("int")))
    copies = points.select("i", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), "q")

    def place(left, right):
        v = left.column("v").to_numpy().astype(float)
        if right.num_rows:
            v = interpolate(v, np.array(right.column("q")[0].as_py()))
        return pa.Table.from_arrays([left.column(SAMPLE), left.column("i"), pa.array(v, from_pandas=False)],
                                    names=[SAMPLE, "i", "v"])

    moved = (long.groupBy("i", "_chunk").cogroup(copies.groupBy("i", "_chunk"))
             .applyInArrow(place, f"{SAMPLE} BIGINT, i INT, v DOUBLE"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))  # one entry per feature
    back = moved.groupBy(SAMPLE).agg(F.transform(ordered, lambda s: s["v"]).alias("data"))
    return matrix.drop("data").join(back, SAMPLE)
