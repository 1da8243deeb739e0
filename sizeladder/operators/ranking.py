"""Exact ranks without gathering a group in one task.

``row_number() over (partition by group ...)`` sends a whole group to one task. Here rows are first
spread over buckets by the leading bits of a uniform draw key. A map-side-combined count per bucket
gives every bucket its starting rank, so ranks only need ordering inside a bucket. With a limit,
buckets that start beyond it are dropped before the shuffle, which leaves a vanishing share of a large
table to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import DRAW_BITS

BITS = 12  # 2**12 buckets per group; add four for every 16-fold growth beyond 10**10 rows


def _bucketed(df: DataFrame, groups: list[str], key: str, bits: int):
    keyed = df.withColumn("_bucket", F.shiftright(F.col(key), DRAW_BITS - bits).cast("int"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("bigint"))))
    return keyed, starts


def rank_by_draw(df: DataFrame, groups: list[str], key: str, tie: str, limit: int | None = None,
                 out: str = "rank", bits: int = BITS) -> DataFrame:
    """Add the 1-based rank of each row in its group by (key, tie); keep ranks up to `limit`.

    `key` is a draw (:func:`sizeladder.functions.draws.draw_key`).
    """
    keyed, starts = _bucketed(df, groups, key, bits)
    on = [*groups, "_bucket"]
    inside = F.row_number().over(Window.partitionBy(*on).orderBy(key, tie))
    rank = F.col("_start") + F.col("_inside")
    if limit is None:
        # numbering first: its sort order also serves the join
        return (keyed.withColumn("_inside", inside).join(starts.drop("_rows"), on)
                .withColumn(out, rank).drop("_bucket", "_start", "_inside"))
    # every bucket holds a row, so at most `limit` (and 2**bits) buckets per group are left
    starts = F.broadcast(starts.where(F.col("_start") < limit).drop("_rows"))
    return (keyed.join(starts, on).withColumn("_inside", inside).where(F.col("_inside") <= limit)
            .withColumn(out, rank).where(F.col(out) <= limit).drop("_bucket", "_start", "_inside"))


def kth_draw(df: DataFrame, groups: list[str], key: str, tie: str, k: Column, bits: int = BITS) -> DataFrame:
    """The k-th smallest (key, tie) of each group, `k` being constant in a group.

    Only the single bucket that holds the answer is sorted; the rest is counted.
    """
    keyed, starts = _bucketed(df.withColumn("_k", k), [*groups, "_k"], key, bits)
    edge = starts.where((F.col("_start") < F.col("_k")) & (F.col("_k") <= F.col("_start") + F.col("_rows")))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(key, tie)
    # one edge row per group
    return (keyed.join(F.broadcast(edge.drop("_rows")), [*groups, "_k", "_bucket"])
            .withColumn("_inside", F.row_number().over(inside))
            .where(F.col("_start") + F.col("_inside") == F.col("_k"))
            .select(*groups, F.col(key).alias("cut_key"), F.col(tie).alias("cut_tie")))
