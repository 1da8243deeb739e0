"""Multi-party chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of it in which their own turns are the assistant's, all others' turns
are named users', and only their own turns are trained on. System turns stay system turns in every perspective and
are no participant.

A dialogue is one row per participant, whatever its number of turns, as long as it has at most `PART_CHARS` characters.
A longer one is cut by rank: part `block` holds the turns that start in the characters from block * PART_CHARS on, counted
over the whole dialogue in order, so a turn is never cut and a number is missing where one turn fills a whole part.
Running counts of long dialogues come from ordered ranges with a small table of starts; nothing is gathered beyond a part.
Every further part begins with the system turns of all earlier parts, unmasked, in order, as far as they fit the first
`PART_CHARS` characters of the dialogue's system turns; `n_turns` and `n_own` do not count these repetitions.
`split` is always 0. Masks are `start:end` in code points of the part's text and cover the turn's text and its end mark.

Turns go by number; turns with the same number, repeated rows among them, go by speaker and text. A null number comes
first, a null speaker is `unknown`, a null text is empty, null conversation ids form one conversation. A conversation of
system turns alone has no participant and no rows. `<|` in texts and names is written `< |`, so that marks stay unique.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import BROADCAST_ROWS, small

#: Characters from which a dialogue is cut, far above usual ones; each turn counts with its heading as another's turn.
PART_CHARS = 4 << 20
SYSTEM = "system"
ASSISTANT = "<|assistant|>\n"
END = "<|end|>"
#: Most turns that fit a part: none has fewer characters than the shortest heading, the end mark and a line feed.
PART_TURNS = PART_CHARS // (len("<|system|>\n" + END) + 1) + 1
#: Characters of a text that ordered ranges are cut by.
RANGE_CHARS = 64


def safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def heading(speaker: Column, participant: Column | None, system: str = SYSTEM) -> Column:
    """The line above a turn; without a participant every turn is another's."""
    other = F.concat(F.lit("<|user name="), speaker, F.lit("|>\n"))
    if participant is not None:
        other = F.when(speaker == participant, F.lit(ASSISTANT)).otherwise(other)
    return F.when(speaker == system, F.lit("<|system|>\n")).otherwise(other)


def placed(rows: DataFrame, long: DataFrame, system: str) -> DataFrame:
    """Rows of long dialogues with `at` and `system_at`, the characters of all turns and of system turns before them.

    Repeated rows are counted first and dealt out again. What is ordered by range is stored, so that starts fit it.
    """
    order = ["turn", "speaker", "text"]
    same = rows.join(long, F.col("_conv").eqNullSafe(F.col("_long"))).groupBy("_conv", *order, "size").agg(
        F.count(F.lit(1)).alias("n"))
    key = [F.col(c) for c in ("_conv", "turn", "speaker")] + [F.substring("text", 1, RANGE_CHARS)]
    ranges = store(same.repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "turn_ranges")
    words = F.col("n") * F.col("size")
    rules = F.when(F.col("speaker") == system, words).otherwise(0)
    sums = ranges.groupBy("_conv", "range").agg(F.sum(words).alias("all"), F.sum(rules).alias("rules"))
    earlier = Window.partitionBy("_conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(sums.select(F.col("_conv").alias("_of"), F.col("range").alias("_range"), *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("all", "rules")]), "turn_starts")
    inside = Window.partitionBy("_conv", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.select("*", F.coalesce(F.sum(words).over(inside), F.lit(0)).alias("_at"),
                         F.coalesce(F.sum(rules).over(inside), F.lit(0)).alias("_system_at"))
    rows = rows.join(small(starts), F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("range") == F.col("_range")))
    before = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")
    rows = rows.select("_conv", *order, "size", "_at", "_system_at", "_all", "_rules", before)
    ahead = F.col("k") * F.col("size")
    return rows.select("_conv", *order, "size", (F.col("_all") + F.col("_at") + ahead).alias("at"),
                       (F.col("_rules") + F.col("_system_at") + ahead).alias("system_at"))


def parts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
          text_col: str = "text", system: str = SYSTEM, part_chars: int = PART_CHARS,
          most: int = BROADCAST_ROWS) -> DataFrame:
    """(_conv, block, turns, head): turns (at, speaker, text) in order, and the texts of the system turns to repeat."""
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("bigint").alias("turn"),
                        safe(F.coalesce(F.col(speaker_col), F.lit("unknown"))).alias("speaker"),
                        safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    rows = rows.withColumn("size", (F.length(heading(F.col("speaker"), None, system)) + F.length("text") + len(END) + 1).cast("bigint"))
    long = store(rows.groupBy("_conv").agg(F.sum("size").alias("_size")).where(F.col("_size") > part_chars).select(
        F.col("_conv").alias("_long")), "long_dialogues")
    turn = F.struct("at", "speaker", "text")
    any_long = not long.isEmpty()
    if any_long:
        long = small(long, most)
        usual = rows.join(long, F.col("_conv").eqNullSafe(F.col("_long")), "left_anti")
    else:
        usual = rows
    before = Window.partitionBy("_conv").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    whole = usual.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).groupBy("_conv").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "_conv", F.lit(0).cast("bigint").alias("block"), "turns", F.lit([]).cast("array<string>").alias("head"))
    if not any_long:
        return whole
    cut = store(placed(rows, long, system), "placed").withColumn("block", F.floor(F.col("at") / part_chars).cast("bigint"))
    rules = cut.where((F.col("speaker") == system) & (F.col("system_at") + F.col("size") <= part_chars)).groupBy("_conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "block", "text"))).alias("rules")).withColumnRenamed("_conv", "_of")
    pieces = cut.groupBy("_conv", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = pieces.join(rules, F.col("_conv").eqNullSafe(F.col("_of")), "left")
    head = F.transform(F.filter("rules", lambda r: r["block"] < F.col("block")), lambda r: r["text"])
    return whole.unionByName(pieces.select("_conv", "block", "turns", F.coalesce(head, F.lit([]).cast("array<string>")).alias("head")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text", system: str = SYSTEM, part_chars: int = PART_CHARS,
           most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per conversation, participant and part: n_turns, n_own, text, masks, mask_chars."""
    name = safe(F.coalesce(F.col(speaker_col), F.lit("unknown")))
    who = (turns.select(F.col(conv_col).alias("_who"), name.alias("participant"))
           .where(F.col("participant") != system).distinct())
    p = parts(turns, conv_col, turn_col, speaker_col, text_col, system, part_chars, most)
    who = small(store(who, "participants"), most)  # few: the texts are not moved a second time
    rows = p.join(who, F.col("_conv").eqNullSafe(F.col("_who")))
    person = F.col("participant")
    mark = F.lit("<|system|>\n")
    ahead = F.transform("head", lambda t: F.concat(mark, t, F.lit(END), F.lit("\n")))
    segments = F.transform("turns", lambda t: F.concat(heading(t["speaker"], person, system), t["text"], F.lit(END), F.lit("\n")))
    rows = rows.select("*", F.array_join(ahead, "").alias("_head"), F.filter("turns", lambda t: t["speaker"] == person).alias("_own"))
    # places count own turns as another's: each own turn before shifts by the difference of both headings
    shift = F.length(heading(person, None, system)) - len(ASSISTANT)
    base = F.length("_head") - F.element_at("turns", 1)["at"] + len(ASSISTANT)

    def span(t: Column, k: Column) -> Column:
        first = base + t["at"] - k * shift
        return F.concat_ws(":", first, first + F.length(t["text"]) + len(END))

    return rows.select(
        F.col("_conv").alias(conv_col), "participant", "block", F.lit(0).alias("split"),
        F.size("turns").cast("bigint").alias("n_turns"), F.size("_own").cast("bigint").alias("n_own"),
        F.concat("_head", F.array_join(segments, "")).alias("text"), F.array_join(F.transform("_own", span), ",").alias("masks"),
        F.aggregate("_own", F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t["text"]) + len(END)).alias("mask_chars"))
