"""Exact deduplication by content hash, with the bytes compared inside every group.

Rows are grouped by a 128-bit hash of the text. Only texts whose hash occurs more than once are looked at again:
they are grouped by (hash, text), so equality of bytes decides and a hash collision splits the group. Map-side
combine leaves one copy of a text per task, so a group of any size moves a text once per task at most. The way
back to the rows is a join of narrow rows on (hash, SHA-256).

Null texts count as empty; empty texts are equal to each other. A null id loses to any other id. Rows that repeat
both id and text are counted in the group size; where the id is the one that stays all of them are marked, and
``deduplicate`` returns one of them. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import BROADCAST_ROWS, repeated_keys, small, text_of


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """(id, content key, SHA-256) per row, stored: every later step but the byte comparison reads only these."""
    text = text_of(text_col)
    return store(docs.select(F.col(id_col).alias("_id"), key(text).alias("_key"),
                             F.unhex(F.sha2(text, 256)).alias("_sha")), "fingerprints")


def verified_groups(docs: DataFrame, prints: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    key: Callable[[Column], Column] = md5_key, keep: str = "smallest",
                    most: int = BROADCAST_ROWS) -> DataFrame:
    """(_key, _sha, keep_id, group_size) for every text that several rows hold, byte for byte."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    members = rows.withColumn("_key", key(F.col("_text"))).join(
        repeated_keys(prints, "_key", "repeated", most), "_key", "left_semi")
    pick = F.min if keep == "smallest" else F.max
    return (members.groupBy("_key", "_text").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1")
            .select("_key", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
         key: Callable[[Column], Column] = md5_key, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and the content key.

    `keep` says which id of a group stays: the smallest or the largest. `key` is the hash that forms groups.
    """
    prints = fingerprints(docs, id_col, text_col, key)
    groups = verified_groups(docs, prints, text_col, id_col, key, keep, most)
    joined = prints.join(groups, ["_key", "_sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
        F.lower(F.hex("_key")).alias("content_key"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that stay, one per distinct text, with the columns of `docs`.

    Rows are matched to the decisions on (id, SHA-256). As long as the rows to drop are few enough to be sent to every
    executor the texts stay where they are; else the join spreads a hot group by its ids.
    """
    marks = store(mark(docs, id_col, text_col, keep, most=most).select(
        F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept"), "marks")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_row"),
                       F.unhex(F.sha2(text_of(text_col), 256)).alias("_print"))
    drop = small(store(marks.where("NOT kept").select("_id", "_sha").distinct(), "drop"), most)
    same = rows["_row"].eqNullSafe(drop["_id"]) & (rows["_print"] == drop["_sha"])
    left = rows.join(drop, same, "left_anti")
    twice = marks.where("kept").groupBy("_id", "_sha").count().where("count > 1")
    if not twice.isEmpty():  # whole rows were repeated
        left = left.dropDuplicates(["_row", "_print"])
    return left.select("_doc.*")
