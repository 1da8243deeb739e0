"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

#: Most rows of a stored key table that are sent to every executor; each row is a key of a few dozen bytes.
BROADCAST_ROWS = 500_000

#: One word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of one Arrow batch of texts. Spark's default of 10,000 rows per batch has no bound in bytes.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Give freed memory of a Python worker back to the system; workers stay alive between tasks."""
    import ctypes

    import pyarrow
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def md5_bits(*parts: Column, digits: int = 15) -> Column:
    """The leading hex digits of an md5 over the parts as a bigint; null parts read as `~`."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def small(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if it has at most `most` rows; larger ones join by shuffle."""
    return F.broadcast(stored) if stored.count() <= most else stored


def repeated_keys(rows: DataFrame, key: str, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Keys that several rows have, counted with map-side combine, stored, and hinted if they are few."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return small(store(found, name), most)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of the shared folder that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
