"""Quality rules as weak supervision.

Every rule votes bad or good on a document, or abstains. Expectation-maximisation over the votes of all documents
estimates, without labels, how often every rule votes on bad and on good documents, hence its accuracy, and the share
of bad documents. A document's posterior probability of being good decides, instead of a list of filters that all must
pass.

A rule speaks for one verdict and abstains otherwise, so a vote pattern is one bit per rule. Patterns are counted with
map-side combine: whatever the corpus, at most 2 ^ rules counts reach the driver, and as many verdicts are sent back.
Two plain rules stand before the votes (`base_failed`): fewer than 10 words, or more than a fifth of the words in
five-word windows that occur twice.

Null texts have no words. Documents without words get no votes and fail the plain rules. Nothing is joined on ids, so
repeated rows and null ids are judged each on their own text; other columns pass through. On an empty table
nothing is estimated and nothing returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import bounded_batches, release_memory, text_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper",
         "n_exclaim", "n_stops")
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

_CLEAN = "50 * n_symbols <= n_words AND 10 * n_upper <= n_words AND 5 * n_repeat_words <= n_words"
#: (rule, -1 votes bad or 1 good, when it votes); all conditions compare whole-text counts.
RULES = (
    ("symbols", -1, "10 * n_symbols > n_words"),
    ("repetition", -1, "100 * n_repeat_words > 20 * n_words"),
    ("lines", -1, "10 * n_dup_lines > 3 * n_lines"),
    ("capitals", -1, "10 * n_upper > 3 * n_words"),
    ("exclamations", -1, "2 * n_exclaim > n_words"),
    ("vocabulary", -1, "n_words >= 50 AND 4 * n_distinct < n_words"),
    ("word_length", -1, "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    ("sentences", -1, "100 * n_stops < n_words"),
    ("prose", 1, f"50 * n_stops >= n_words AND 5 * n_stops <= 3 * n_words AND 10 * n_exclaim <= n_words AND {_CLEAN}"),
    ("varied", 1, f"5 * n_distinct >= 2 * n_words AND {_CLEAN}"),
    ("plain", 1, f"2 * word_chars >= 7 * n_words AND word_chars <= 8 * n_words AND 5 * n_dup_lines <= 2 * n_lines AND {_CLEAN}"),
)

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


def text_stats(text: str) -> tuple[int, ...]:
    """The counts named in STATS for one whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split cuts at exactly the six SPACES
    n, seen = len(words), {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if n > 5:
        window = sum((ids[k:n - 4 + k] + np.uint64(1)) * m for k, m in enumerate(_MIX))
        _, place, counts = np.unique(window, return_inverse=True, return_counts=True)
        twice = counts[place] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(5):
            covered[k:n - 4 + k] |= twice
        repeated = int(covered.sum())
    times = np.bincount(ids.astype(np.int64), minlength=len(seen)) if n else np.zeros(0, dtype=np.int64)
    upper = np.fromiter((len(w) > 1 and w.isupper() for w in seen), dtype=bool, count=len(seen))
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines), len(seen), int(times[upper].sum()), text.count("!"), text.count(".") + text.count(","))


@F.pandas_udf(T.StructType([T.StructField(s, T.LongType()) for s in STATS]))
def stats_of(texts: pd.Series) -> pd.DataFrame:
    stats = pd.DataFrame([text_stats(t) for t in texts], columns=STATS, dtype="int64")
    release_memory()
    return stats


def vote_code() -> Column:
    """The votes as one number: bit k is set where rule k votes."""
    code = F.lit(0)
    for place, (_, _, when) in enumerate(RULES):
        code = code + F.when((F.col("n_words") > 0) & F.expr(when), 1 << place).otherwise(0)
    return code.cast("int")


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Rows of -1, 0 (abstains), 1 per rule."""
    return (codes[:, None] >> np.arange(len(RULES))[None, :] & 1) * np.array([sign for _, sign, _ in RULES])


@dataclass
class RuleModel:
    """Share of bad documents, and how often each rule votes on bad and on good ones."""

    bad_share: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good. An abstention counts for what it says: a rule that votes on nearly all good documents
        and is silent on this one makes it less likely to be good."""
        odds = np.log1p(-self.bad_share) - np.log(self.bad_share)
        odds = odds + (votes != 0) @ (np.log(self.on_good) - np.log(self.on_bad))
        odds = odds + (votes == 0) @ (np.log1p(-self.on_good) - np.log1p(-self.on_bad))
        return 1 / (1 + np.exp(-odds))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among a rule's votes."""
        bad, good = self.bad_share * self.on_bad, (1 - self.bad_share) * self.on_good
        return {name: float((b if sign < 0 else g) / (b + g)) for (name, sign, _), b, g in zip(RULES, bad, good)}


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> RuleModel:
    """Expectation-maximisation over vote patterns with their counts.

    It starts from the majority of votes. One pseudo-vote on either side keeps rates inside (0, 1), and no rule is taken
    to be worse than chance: it votes at least as often on documents of its own verdict as on others.
    """
    weight, voted = counts.astype(float), votes != 0
    against = np.array([sign < 0 for _, sign, _ in RULES])
    good = np.where(votes.sum(axis=1) < 0, 0.05, 0.95)
    for _ in range(rounds):
        on_bad, on_good = (((w[:, None] * voted).sum(0) + 1) / (w.sum() + 2) for w in (weight * (1 - good), weight * good))
        both = ((weight[:, None] * voted).sum(0) + 1) / (weight.sum() + 2)
        wrong = np.where(against, on_good > on_bad, on_bad > on_good)
        on_bad, on_good = np.where(wrong, both, on_bad), np.where(wrong, both, on_good)
        share = ((weight * (1 - good)).sum() + 1) / (weight.sum() + 2)
        model = RuleModel(float(share), on_bad, on_good)
        now = model.posterior(votes)
        moved, good = float(np.abs(now - good).max(initial=0.0)), now
        if moved < tolerance:
            break
    return model


def verdicts(codes: DataFrame, keep: float = 0.5) -> tuple[DataFrame, RuleModel]:
    """(_code, quality, good) per vote pattern of `codes`, and the model; at most 2 ^ rules rows."""
    table = codes.groupBy("_code").agg(F.count(F.lit(1)).alias("n")).orderBy("_code").collect()
    patterns = np.array([r["_code"] for r in table], dtype=np.int64)
    votes = votes_of(patterns)
    model = fit(votes, np.array([r["n"] for r in table], dtype=np.int64))
    quality = model.posterior(votes)
    rows = [(int(c), float(p), bool(p >= keep)) for c, p in zip(patterns, quality)]
    return codes.sparkSession.createDataFrame(rows, "_code int, quality double, good boolean"), model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """One row per input row: id, the counts, base_failed, quality (posterior of good), kept."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), stats_of(text_of(text_col)).alias("_s")).select("_id", "_s.*")
    rows = store(rows.withColumn("_code", vote_code()), "votes")
    table, _ = verdicts(rows, keep)
    failed = F.expr(BASE_FAILED)
    return rows.join(F.broadcast(table), "_code").select(
        F.col("_id").alias(id_col), *STATS, failed.alias("base_failed"), "quality",
        (~failed & F.col("good")).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", keep: float = 0.5) -> DataFrame:
    """The documents that `judge` keeps, with their own columns.

    Counts are taken again on the second pass, so texts are filtered where they lie.
    """
    bounded_batches(docs.sparkSession)
    stats = stats_of(text_of(text_col))
    table, _ = verdicts(docs.select(stats.alias("_s")).select("_s.*").select(vote_code().alias("_code")), keep)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), stats.alias("_s")).select("_doc", "_s.*")
    good = (rows.where(~F.expr(BASE_FAILED)).withColumn("_code", vote_code())
            .join(F.broadcast(table.where("good")), "_code", "left_semi"))
    return good.select("_doc.*")
