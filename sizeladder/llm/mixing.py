"""Mixing sources to target weights by nested hash thresholds.

Every row draws a stable hash, 32 bits of its id and 28 of its text, so that rows which share an id, or have none, are told
apart. A source's budget is a hash threshold: rows below it are taken. The
threshold is found by histograms: words are summed by source and leading hash digit with map-side combine, a running
sum over the digits names the bucket in which the budget runs out, and only rows of that bucket are summed again by
the next digit. After the last digit the bucket is a single hash value, taken if that brings the sum nearer to the
budget. Rows are never sorted, and a smaller budget of the same source takes a subset of a larger one's rows.

A source that wants more than it has is taken whole once or twice and the threshold covers the rest, so no row is
taken more than `most_copies` times. Null texts and texts without words have size 0 and are never counted as taken.
A null source is a source of its own, last in order. Only rows that repeat id and text share a hash and are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import WORD, md5_bits, small, text_of

#: Bits of the hash that each histogram looks at, from the leading ones.
DIGITS = (12, 10, 10, 14, 14)
TEXT_BITS = 28


def row_hash(id_col: str, text_col: str) -> Column:
    """The id decides; the text only among rows of the same id."""
    of_id, of_text = md5_bits(F.col(id_col), digits=8), md5_bits(text_of(text_col), digits=TEXT_BITS // 4)
    return F.shiftleft(of_id, TEXT_BITS) + of_text


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, no_source, size, hash), stored: the histograms and the filter read only these."""
    return store(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
                             F.col(source_col).isNull().alias("_none"), word_count(text_col).alias("size"),
                             row_hash(id_col, text_col).alias("_hash")), "sized")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_copies: int = 3,
                   share: float = 1.0) -> DataFrame:
    """(source, no_source, source_size, target, whole, budget) per source.

    Sources in code point order, null last, take the weights in turn. They split `share` of all words by weight; no
    source gets more than `most_copies` times its size, and what it leaves is split again by weight among the others.
    That is one level L with target = min(cap, weight * L): sources are capped in order of cap / weight.
    """
    sizes = rows.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy("_none", "_source")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    s = (sizes.withColumn("_w", weight)
         .withColumn("_cap", F.lit(float(most_copies)) * F.col("source_size"))
         .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    order = Window.orderBy("_ratio", "_none", "_source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = ((total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the first source in this order that its level does not reach fixes the level for all after it
    s = s.withColumn("_level", level).withColumn(
        "_fixed", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("_fixed").isNull(), F.col("_cap")).otherwise(F.col("_fixed") * F.col("_w"))
    s = s.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return store(s.withColumn("whole", F.least(whole, F.lit(most_copies)).cast("bigint"))
                 .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
                 .select("_none", "_source", "source_size", "target", "whole", "budget"), "targets")


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, no_source, threshold): rows of the source with a hash below it are taken once more."""
    source = ["_none", "_source"]
    edge = targets.where("budget > 0").select(*source, F.col("budget").alias("_left"), F.lit(0).cast("bigint").alias("_prefix"))
    shift = sum(DIGITS)
    for bits in DIGITS:
        inside = rows.where("size > 0").withColumn("_prefix", F.shiftright("_hash", shift))
        shift -= bits
        digit = F.shiftright("_hash", shift).bitwiseAND((1 << bits) - 1)
        sums = (inside.join(small(edge), [*source, "_prefix"]).groupBy(*source, "_prefix", "_left", digit.alias("_digit"))
                .agg(F.sum("size").alias("_words")))
        up_to = Window.partitionBy(*source).orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("_sum", F.sum("_words").over(up_to)).where("_sum > _left")
        first = over.groupBy(*source).agg(F.min(F.struct("_digit", "_prefix", "_words", (
            F.col("_left") - (F.col("_sum") - F.col("_words"))).alias("_left"))).alias("_e"))
        edge = store(first.select(*source, F.col("_e._left").alias("_left"), F.col("_e._words").alias("_words"), (
            F.shiftleft("_e._prefix", bits) + F.col("_e._digit")).alias("_prefix")), "edge")
    nearer = F.when(2 * F.col("_left") > F.col("_words"), 1).otherwise(0)
    return edge.select(*source, (F.col("_prefix") + nearer).alias("threshold"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[float, ...] = (1, 2, 3), most_copies: int = 3, share: float = 1.0) -> DataFrame:
    """One row per input row: id, source, size, source_size, target of its source, copies, taken words."""
    rows = sized_rows(docs, id_col, source_col, text_col)
    targets = source_targets(rows, weights, most_copies, share)
    plan = targets.join(thresholds(rows, targets), ["_none", "_source"], "left")
    joined = rows.join(small(store(plan, "plan")), ["_none", "_source"])
    copies = (F.col("whole") + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return joined.select(
        F.col("_id").alias(id_col), F.when(~F.col("_none"), F.col("_source")).alias(source_col), "size", "source_size",
        "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               weights: tuple[float, ...] = (1, 2, 3), most_copies: int = 3, share: float = 1.0) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of `docs`.

    The hash is computed again on the rows, so whole texts are filtered where they lie.
    """
    rows = sized_rows(docs, id_col, source_col, text_col)
    targets = source_targets(rows, weights, most_copies, share)
    plan = store(targets.join(thresholds(rows, targets), ["_none", "_source"], "left"), "plan")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), row_hash(id_col, text_col).alias("_hash"),
                        F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
    copies = (F.col("whole") + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return (keyed.join(small(plan.select("_none", "_source", "whole", "threshold")), ["_none", "_source"])
            .withColumn("_copies", copies).where("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*"))
