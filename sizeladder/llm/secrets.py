"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Three patterns give the base spans. Beyond them, every run of identifier characters is scored by the log-likelihood
ratio of two first-order character models, one of random strings and one of ordinary identifiers; a run over the
threshold that overlaps no base span is added with kind `random`, unless it is a drawn line or the alphabet in order. The models are two tables of character pairs, as
large as the alphabet squared whatever they are trained on, counted from labelled strings.

Positions come from SQL functions alone: a pattern's matches and the texts between them alternate, so the lengths of
both give the spans, in code points of the whole text. Null texts count as empty; a text without finds has empty spans.
Rows are scanned each on their own; repeated rows, null ids and other columns make no difference. Very long texts are
scanned whole: n spans of one text cost about n ** 1.5 small steps. An empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_bits, text_of

# The patterns and lengths of the base spans, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Shortest run that is scored, and shortest identifier to learn from.
SCORED, LEARNED = 16, 8
#: Log-likelihood ratio, in nats, from which a run counts as random.
THRESHOLD = 10.0
#: Documents that labelled strings are taken from; a bound on training rows only.
TRAIN_DOCS = 20_000
#: Different characters a random run has at least; 16 random hex digits have fewer with a chance of 4e-7.
LEAST_CHARACTERS = 5
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def runs(least: int) -> str:
    return f"[A-Za-z0-9+/_=-]{{{least},}}"


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op, zero: int) -> Column:
    """Running totals of an array of integers under an associative `op`.

    An array grows by copying, so totals are built within blocks of about the square root of the length, then over
    the blocks: n entries cost n ** 1.5 copied integers, not n ** 2.
    """
    def totals(part: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.lit([]).cast("array<int>").alias("all"))

        def step(acc: Column, v: Column) -> Column:
            return let(op(acc["at"], v), lambda now: F.struct(now.alias("at"), F.concat(acc["all"], F.array(now)).alias("all")))

        return F.aggregate(part, start, step, lambda acc: acc["all"])

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(v), size), lambda at: totals(F.slice(v, at, size)))

    def joined(parts: Column) -> Column:
        before = let(totals(F.transform(parts, lambda p: F.element_at(p, -1))),
                     lambda t: F.concat(F.array(F.lit(zero)), F.slice(t, 1, F.size(t) - 1)))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda v: op(b, v))))

    return F.when(F.size(values) > 0, let(values, lambda v: let(blocks(v), joined))).otherwise(F.lit([]).cast("array<int>"))


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that do not overlap, as (start, kind, stop, value); `value` is a group of at least `least`."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(found: Column) -> Column:
        sizes = F.zip_with(F.slice(found["gap"], 1, F.size(found["whole"])), found["whole"],
                           lambda g, w: F.length(g) + F.length(w))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found["whole"]
        rows = F.arrays_zip(running(sizes, lambda a, b: a + b, 0).alias("stop"), found["whole"].alias("whole"),
                            value.alias("value"))
        return F.transform(F.filter(rows, lambda r: F.length(r["value"]) >= least), lambda r: F.struct(
            (r["stop"] - F.length(r["whole"])).alias("start"), F.lit(kind).alias("kind"), r["stop"].alias("stop"),
            r["value"].alias("value")))

    found = let(F.struct(between.alias("gap"), whole.alias("whole")), spans)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.lit([])).cast(SPAN)


def base_spans(text: Column) -> Column:
    """Runs shorter than the least length never hide a longer one, so the last two patterns ask for it at once."""
    access, hexa = ACCESS[:-1] + f"{{{LEAST['access'] - 4},}}", HEX[:-1] + f"{{{LEAST['hex']},}}"
    return F.concat(matches(text, ASSIGN, 0, 2, LEAST["assign"]), matches(text, access, 1), matches(text, hexa, 2))


def clear_of(spans: Column, others: Column) -> Column:
    """Those of `spans`, which do not overlap each other, that overlap none of `others`; by start.

    Both are put in one order, a span by its stop and the others by their start. A span is hit if the last stop of
    those that start before it ends lies behind its own start.
    """
    def kept(s: Column, o: Column) -> Column:
        event = "array<struct<at:int,later:int,own:int,span:struct<start:int,kind:int,stop:int,value:string>>>"
        mine = F.transform(s, lambda x: F.struct(x["stop"], F.lit(0), F.lit(-1), x)).cast(event)
        theirs = F.transform(o, lambda x: F.struct(x["start"], F.lit(1), x["stop"], F.lit(None))).cast(event)
        return let(F.array_sort(F.concat(mine, theirs)), clear)

    def clear(events: Column) -> Column:
        last = running(F.transform(events, lambda e: e["own"]), F.greatest, -1)
        pairs = F.filter(F.arrays_zip(events.alias("e"), last.alias("last")),
                         lambda p: p["e"]["span"].isNotNull() & (p["last"] <= p["e"]["span"]["start"]))
        return F.transform(pairs, lambda p: p["e"]["span"])

    return let(F.struct(spans.alias("s"), others.alias("o")), lambda x: F.when(
        (F.size(x["s"]) > 0) & (F.size(x["o"]) > 0), kept(x["s"], x["o"])).otherwise(x["s"]))


def char_codes(value: Column) -> Column:
    """Places of the characters in the alphabet, from 1; 0 for any other."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(value, random) from about `train_docs` documents, chosen by a hash of their id.

    What the fixed patterns find is random; other runs of identifier characters are ordinary.
    """
    n = docs.count()
    sample = docs.where(md5_bits(F.col(id_col)) < int(min(1.0, train_docs / max(n, 1)) * 2 ** 60))
    rows = sample.select(text_of(text_col).alias("_text")).select("_text", base_spans(F.col("_text")).alias("_base"))
    plain = clear_of(matches(F.col("_text"), runs(LEARNED), 3), F.col("_base"))
    both = F.concat(F.transform("_base", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("random"))),
                    F.transform(plain, lambda s: F.struct(s["value"].alias("value"), F.lit(False).alias("random"))))
    return rows.select(F.inline(both))


def patterned(value: Column) -> Column:
    """Whether a run is a drawn line or a stretch of the alphabet: few different characters, or mostly the next one."""
    codes = char_codes(value)
    steps = let(codes, lambda c: F.size(F.filter(F.zip_with(
        F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: b - a == 1), lambda x: x)))
    return (F.size(F.array_distinct(codes)) < LEAST_CHARACTERS) | (steps * 2 > F.length(value))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every pair of characters, at (first - 1) * size + second - 1."""
    size = len(ALPHABET)
    codes = labelled.where("value IS NOT NULL").select("random", char_codes(F.col("value")).alias("_codes"))
    pair = F.zip_with(F.slice("_codes", 1, F.size("_codes") - 1), F.slice("_codes", 2, F.size("_codes") - 1),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = codes.where(F.size("_codes") > 1).select("random", F.inline(pair)).where("a > 0 AND b > 0").groupBy(
        "random", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = {True: {}, False: {}}
    for r in counted.collect():  # at most twice the alphabet squared
        counts[r["random"]][r["a"], r["b"]] = r["n"]

    def log_share(table: dict, a: int) -> list[float]:
        row = [table.get((a, b), 0) + smoothing for b in range(1, size + 1)]
        return [math.log(x / sum(row)) for x in row]

    return [r - o for a in range(1, size + 1) for r, o in zip(log_share(counts[True], a), log_share(counts[False], a))]


def log_ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of alphabet characters, random against ordinary."""
    size = len(ALPHABET)
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    codes = F.transform(char_codes(value), lambda c: c - 1)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * size + b)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, counts per kind, base_sha256, spans, and the spans as an array."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_id", "_text", F.array_sort(base_spans(F.col("_text"))).alias("_base"))
    runs_found = clear_of(matches(F.col("_text"), runs(SCORED), 3), F.col("_base"))
    rows = rows.select("_id", "_base", F.filter(
        runs_found, lambda s: (log_ratio(s["value"], model) > threshold) & ~patterned(s["value"])).alias("_more"))
    rows = rows.select("_id", "_base", F.array_sort(F.concat("_base", "_more")).alias("_all"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("bigint")

    return rows.select(F.col("_id").alias(id_col), *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                       F.sha2(text("_base"), 256).alias("base_sha256"), text("_all").alias("spans"))
