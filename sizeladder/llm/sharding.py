"""Sharding by jump consistent hash (Lamping and Veach, 2014).

The shard of a key is computed from a 60-bit hash of the key and the number of shards alone; there is no ring table.
Going from n to n + 1 shards moves one key in n + 1, all of them into the new shard.

A row's place in its shard is its rank by a hash of its id and its text's md5. No shard is ever in one task: rows are ranked inside
narrow ranges of the hash, and the start of each range comes from a table of counts with a fixed number of rows.
A hot key puts its rows into one shard, as consistent hashing has it, but its rows are ranked by their own ids and
texts; only rows equal in both stay together.

A null key is a key of its own; null texts count as empty. Repeated rows each get a place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import md5_bits, text_of

#: Leading bits of the row's hash that form the ranges in which rows are ranked.
RANGE_BITS = 12
KEY_BITS = 60


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers of non-negative integer keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state, at = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    ahead, live = at.copy(), np.arange(len(keys))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a hashed key as an int column."""
    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards), dtype="int32")
    return place(key)


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", key_col: str | None = None,
           text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    text = text_of(text_col)
    key = md5_bits(F.col(key_col or id_col))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), key.alias("_key"), md5_bits(F.col(id_col), F.md5(text)).alias("_order"))
    rows = store(rows.select("*", shard_of(F.col("_key"), shards).alias("shard"),
                             shard_of(F.col("_key"), shards + 1).alias("grown_shard"),
                             F.shiftright("_order", KEY_BITS - RANGE_BITS).cast("int").alias("_range")), "sharded")
    counts = rows.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_order", "_id", "text_crc32", "size")) - 1
    # at most shards * 2^RANGE_BITS rows
    placed = rows.withColumn("_rank", rank).join(F.broadcast(starts), ["shard", "_range"])
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("_start") + F.col("_rank")).cast("bigint").alias("slot"), "grown_shard")
