"""Near-duplicate join on word shingles with Bayesian candidate pruning (after BayesLSH, Satuluri and Parthasarathy 2012).

The similarity of two texts is the Jaccard index of their sets of five-word shingles; pairs of 0.8 or more are linked.
A text of fewer than five words is one shingle of all its words; one without words has none and is never linked.

1. Every text becomes 128 MinHash values and a 128-bit digest of its shingle set. Texts with equal sets are one class, so
   copies cost one row however many there are.
2. Classes that agree in a band of 4 values are candidates. A pair at the threshold misses all 32 bands with a chance
   of 5e-8.
3. A candidate pair compares its values 16 at a time. With a uniform prior the posterior of the similarity after m of n
   matches is Beta(m + 1, n - m + 1); as soon as its mass at or above the threshold is below the tolerance, the pair is
   dropped. At a tolerance of 1e-6 all checks together lose fewer than one true pair in 100,000.
4. The rest is verified on the whole texts: the exact Jaccard index of the full sets of 64-bit shingle hashes.

Band buckets of up to `SMALL_BUCKET` classes are expanded to pairs. Larger ones are not: classes that meet in large
buckets form clusters, a cluster is cut into blocks of bounded size by shingle count, and blocks that can hold pairs over
the threshold are compared two at a time. Such a task gives back a number of links per class and a spanning forest of
the links, so a group of m near copies makes rows in proportion to m times its blocks, not m squared, and no link is
lost or capped. Links become groups by connected components over stored tables.

Null texts count as empty. All texts without words are one class. A row is known by (id, md5 of the text): repeated rows
and null ids keep their own place in the result. The one that stays of a group has the smallest id, null last, and of the texts
under that id the smallest md5; rows that repeat both are all marked, and `keep_one` returns one of them. Other columns are
never read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import BROADCAST_ROWS, bounded_batches, release_memory, small, text_of
from .components import components

WORDS = 5
THRESHOLD = 0.8
HASHES, BAND = 128, 4
STEP = 16
TOLERANCE = 1e-6
#: Largest band bucket that is expanded to pairs.
SMALL_BUCKET = 16
#: Most classes, and about the most shingles, of one block of a cluster.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash
    parts = text.encode("utf-8", "surrogatepass").split()  # cuts at space, tab, LF, VT, FF and CR only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + h[k:k + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def hash_family(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240501))
    return (draw.integers(0, 2**64, size=(hashes, 1), dtype=np.uint64) | np.uint64(1),
            draw.integers(0, 2**64, size=(hashes, 1), dtype=np.uint64))


def min_hashes(values: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value under each function, as 32-bit numbers."""
    odd, add = family
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 1024):
        np.minimum(least, (values[None, at:at + 1024] * odd + add).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES,
                  step: int = STEP) -> list[int]:
    """After `step`, 2 `step`, ... values: the fewest matches with which a pair stays.

    Pr[similarity >= t | m of n] under a uniform prior is the chance of at most m successes in n + 1 trials of rate t.
    """
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, limits: list[int],
              step: int = STEP) -> np.ndarray:
    """Places of the pairs (left[i], right[j]) that no check drops."""
    alive, matched = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for k, limit in enumerate(limits):
        part = slice(k * step, (k + 1) * step)
        matched = matched + (left[i[alive], part] == right[j[alive], part]).sum(axis=1)
        stays = matched >= limit
        alive, matched = alive[stays], matched[stays]
    return alive


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, _md5, c, n, sig) per row: digest of the shingle set, its size, and the MinHash values."""
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = hash_family()
        for batch in batches:
            sets = [shingles(t, words) for t in batch["_text"]]
            yield pd.DataFrame({
                "_id": batch["_id"].astype("Int64"), "_md5": batch["_md5"],
                "c": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "n": np.array([len(s) for s in sets], dtype=np.int32),
                "sig": [min_hashes(s, family).tobytes() for s in sets]})
        release_memory()

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.unhex(F.md5(text)).alias("_md5"), text.alias("_text"))
    return rows.mapInPandas(sketch, "_id bigint, _md5 binary, c binary, n int, sig binary")


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(len(sigs), HASHES)


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(sigs: pd.Series) -> pd.Series:
    """One 64-bit key per band, the band's number mixed in."""
    values = _matrix(sigs).astype(np.uint64).reshape(len(sigs), HASHES // BAND, BAND)
    key = np.broadcast_to(np.arange(HASHES // BAND, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(BAND):
        key = (key ^ (key >> np.uint64(31))) * _PRIME + values[:, :, k] * _MIX
    key ^= key >> np.uint64(29)
    return pd.Series(list(key.view(np.int64)))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, c, m, head) for every class in a band bucket of m >= 2 classes, stored."""
    rows = classes.where("n > 0").select("c", F.explode(band_keys("sig")).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("head")).where("m > 1")
    return store(rows.join(small(store(shared, "shared")), "key"), "buckets")


def pairs_of_small(members: DataFrame, clusters: DataFrame | None, largest: int = SMALL_BUCKET) -> DataFrame:
    """Distinct candidate pairs (a < b) of the small buckets, without pairs inside one cluster."""
    rows = members.where(F.col("m") <= largest).select("key", "c")
    if clusters is None:
        rows = rows.withColumn("cluster", F.lit(None).cast("binary"))
    else:
        rows = rows.join(clusters, "c", "left")
    group = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "cluster"))).alias("g"))  # at most `largest`

    def with_later(x, i):
        later = F.filter(F.slice("g", i + 2, largest), lambda y: F.coalesce(x["cluster"] != y["cluster"], F.lit(True)))
        return F.transform(later, lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))

    return group.select(F.inline(F.flatten(F.transform("g", with_later)))).distinct()


def prune(pairs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The candidate pairs that the posterior does not rule out."""
    limits = least_matches(threshold, tolerance)

    @F.pandas_udf("boolean")
    def stays(sig_a: pd.Series, sig_b: pd.Series) -> pd.Series:
        at, out = np.arange(len(sig_a)), np.zeros(len(sig_a), dtype=bool)
        out[survivors(_matrix(sig_a), _matrix(sig_b), at, at, limits)] = True
        return pd.Series(out)

    side = classes.select("c", "n", "sig")
    both = (pairs.join(side.toDF("a", "n_a", "sig_a"), "a").join(side.toDF("b", "n_b", "sig_b"), "b")
            .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    return both.where(stays("sig_a", "sig_b")).select("a", "b")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str,
             most: int = BROADCAST_ROWS) -> DataFrame:
    """(c, text) for the wanted classes, read from the row that stands for each; stored."""
    reps = store(classes.join(wanted, "c", "left_semi").select("c", "rep"), "reps")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.unhex(F.md5(text)).alias("_md5"), text.alias("text"))
    same = rows["_id"].eqNullSafe(F.col("rep._id")) & (rows["_md5"] == F.col("rep._md5"))
    return store(rows.join(small(reps, most), same).select("c", "text").dropDuplicates(["c"]), "texts")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold."""
    @F.pandas_udf("boolean")
    def linked(text_a: pd.Series, text_b: pd.Series) -> pd.Series:
        out, last, left = [], None, None
        for a, b in zip(text_a, text_b):
            if a is not last:
                last, left = a, shingles(a, words)
            right = shingles(b, words)
            common = len(np.intersect1d(left, right, assume_unique=True))
            out.append(common >= threshold * (len(left) + len(right) - common))
        release_memory()
        return pd.Series(out, dtype=bool)

    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.where(linked("text_a", "text_b")).select("a", "b")


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame | None, limits: list[int], threshold: float = THRESHOLD,
                   words: int = WORDS) -> tuple[list, list]:
    """Links per class and spanning links of two blocks, or of one block with itself."""
    alone = right is None
    right = left if alone else right
    a, b = left["n"].to_numpy(), right["n"].to_numpy()
    i, j = np.triu_indices(len(a), 1) if alone else (x.ravel() for x in np.indices((len(a), len(b))))
    fits = np.minimum(a[i], b[j]) >= threshold * np.maximum(a[i], b[j])
    i, j = i[fits], j[fits]
    alive = survivors(_matrix(left["sig"]), _matrix(right["sig"]), i, j, limits)
    i, j = i[alive], j[alive]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]

    # exact: number the shingles of both blocks, mark one text's, count the marks in each partner's
    needed_right = np.unique(j)
    sets = {("a", k): shingles(left["text"].iloc[k], words) for k in np.unique(i)}
    sets |= {("b", k): shingles(right["text"].iloc[k], words) for k in needed_right}
    keys = list(sets)
    numbered = np.unique(np.concatenate([sets[k] for k in keys]), return_inverse=True)[1] if keys else np.zeros(0, int)
    ends = np.cumsum([len(sets[k]) for k in keys])
    codes = {k: numbered[e - len(sets[k]):e] for k, e in zip(keys, ends)}
    mark = np.zeros(int(numbered.max()) + 1 if len(numbered) else 0, dtype=bool)
    linked = np.zeros(len(i), dtype=bool)
    at = 0
    while at < len(i):
        end = int(np.searchsorted(i, i[at], side="right"))
        own, partners = codes["a", i[at]], [codes["b", k] for k in j[at:end]]
        mark[own] = True
        sizes = np.array([len(p) for p in partners])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        common = np.add.reduceat(mark[np.concatenate(partners)].astype(np.int64), starts)
        linked[at:end] = common >= threshold * (len(own) + sizes - common)
        mark[own] = False
        at = end
    i, j = i[linked], j[linked]

    name_a, name_b = left["c"].tolist(), right["c"].tolist()
    links: dict[bytes, int] = {}
    for names, places in ((name_a, i), (name_b, j)):
        for k, times in zip(*np.unique(places, return_counts=True)):
            links[names[k]] = links.get(names[k], 0) + int(times)
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    forest = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(name_a[x]), root(name_b[y])
        if p != q:
            parent[p] = q
            forest.append((name_a[x], name_b[y]))
    return list(links.items()), forest


def cluster_links(clusters: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD,
                  tolerance: float = TOLERANCE, words: int = WORDS, block_rows: int = BLOCK_ROWS,
                  block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(c, other, links): numbers of links inside clusters (other null) and spanning links (links null); stored.

    Sizes fall into bands whose bounds grow by 1 / threshold, so linked classes are in the same or the next band.
    """
    rows = clusters.join(classes.select("c", "n", "sig"), "c")
    band = F.floor(F.log("n") / float(-np.log(threshold))).cast("int")
    rows = rows.withColumn("band", band)
    counts = rows.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("longest"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(block_shingles) / F.col("longest"))))
    counts = store(counts.select("cluster", "band", F.ceil(F.col("m") / per_block).cast("int").alias("blocks")), "blocks")
    above = counts.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = counts.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    sizes = counts.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    rows = rows.join(small(store(sizes, "sizes")), ["cluster", "band"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))

    def places(count, make):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array())

    def pair(band_1, block_1, band_2, block_2, side):
        return F.struct(band_1.alias("band_1"), block_1.alias("block_1"), band_2.alias("band_2"), block_2.alias("block_2"),
                        side.alias("side"))

    band, block = F.col("band"), F.col("block")
    same = places(F.col("blocks"), lambda k: pair(band, F.least(block, k), band, F.greatest(block, k),
                                                  F.when(block <= k, 0).otherwise(1)))
    up = places(F.col("above"), lambda k: pair(band, block, band + 1, k, F.lit(0)))
    down = places(F.col("below"), lambda k: pair(band - 1, k, band, block, F.lit(1)))
    kind = "array<struct<band_1:int,block_1:int,band_2:int,block_2:int,side:int>>"
    spread = rows.join(texts, "c").select(
        "cluster", "c", "n", "sig", "text", F.inline(F.concat(same.cast(kind), up.cast(kind), down.cast(kind))))
    limits = least_matches(threshold, tolerance)

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        one = block[["band_1", "block_1"]].iloc[0].tolist() == block[["band_2", "block_2"]].iloc[0].tolist()
        left, right = block[block["side"] == 0], None if one else block[block["side"] == 1]
        links, forest = compare_blocks(left, right, limits, threshold, words)
        return pd.DataFrame([(c, None, k) for c, k in links] + [(a, b, None) for a, b in forest],
                            columns=["c", "other", "links"]).astype({"links": "Int64"})

    key = ["cluster", "band_1", "block_1", "band_2", "block_2"]
    return store(spread.groupBy(*key).applyInPandas(compare, "c binary, other binary, links bigint"), "cluster_links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE, words: int = WORDS, small_bucket: int = SMALL_BUCKET,
                    block_rows: int = BLOCK_ROWS, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, class_id, class_size, n_shingles, n_links, group_id, kept.

    class_id is the smallest id of the texts with the same shingle set, n_links the number of other classes that its class
    is linked to, group_id the smallest id of all classes connected by links; kept marks that document.
    """
    bounded_batches(docs.sparkSession)
    rows = store(sketches(docs, id_col, text_col, words), "sketches")
    classes = store(rows.groupBy("c").agg(
        F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_md5")).alias("rep"), F.count(F.lit(1)).alias("size"),
        F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    members = buckets(classes)

    large = members.where(F.col("m") > small_bucket)
    clusters = None
    if not large.isEmpty():
        found = components(large.select(F.col("c").alias("a"), F.col("head").alias("b")))
        clusters = store(found.select(F.col("node").alias("c"), F.col("label").alias("cluster")), "clusters")
    pairs = store(prune(pairs_of_small(members, clusters, small_bucket), classes, threshold, tolerance), "pairs")
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c")))
    if clusters is not None:
        wanted = wanted.unionByName(clusters.select("c"))
    texts = texts_of(docs, classes, wanted.distinct(), id_col, text_col, most)
    edges = store(verify(pairs, texts, threshold, words), "links")
    counts = edges.select(F.explode(F.array("a", "b")).alias("c")).withColumn("links", F.lit(1).cast("bigint"))
    if clusters is not None:
        inside = cluster_links(clusters, classes, texts, threshold, tolerance, words, block_rows)
        counts = counts.unionByName(inside.where("other IS NULL").select("c", "links"))
        edges = edges.unionByName(inside.where("other IS NOT NULL").select(F.col("c").alias("a"), F.col("other").alias("b")))

    labels = components(edges).withColumnRenamed("node", "c")
    named = classes.select("c", F.col("rep._id").alias("class_id"), "rep", "size", "n")
    table = (named.join(counts.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(labels, "c", "left"))
    table = store(table.withColumn("label", F.coalesce("label", "c")), "table")
    groups = table.groupBy("label").agg(F.min("rep").alias("stays"))
    verdict = store(table.join(groups, "label").select("c", "class_id", "size", "n", F.coalesce("links", F.lit(0)).alias(
        "links"), F.col("stays._id").alias("group_id"), F.col("stays._md5").alias("stays_md5")), "verdict")
    kept = F.col("_id").eqNullSafe(F.col("group_id")) & (F.col("_md5") == F.col("stays_md5"))
    return rows.select("_id", "_md5", "c").join(verdict, "c").select(
        F.col("_id").alias(id_col), "class_id", F.col("size").alias("class_size"), F.col("n").cast("bigint").alias("n_shingles"),
        F.col("links").alias("n_links"), "group_id", kept.alias("kept"), "_md5")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_ROWS,
             **options) -> DataFrame:
    """The documents that stay, one per group of near duplicates, with the columns of `docs`."""
    marks = store(near_duplicates(docs, id_col, text_col, most=most, **options).select(
        F.col(id_col).alias("_id"), F.col("_md5").alias("_drop"), "kept"), "near_marks")
    drop = small(store(marks.where("NOT kept").select("_id", "_drop").distinct(), "near_copies"), most)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_row"),
                       F.unhex(F.md5(text_of(text_col))).alias("_md5"))
    same = rows["_row"].eqNullSafe(drop["_id"]) & (rows["_md5"] == drop["_drop"])
    left = rows.join(drop, same, "left_anti")
    twice = marks.where("kept").groupBy("_id", "_drop").count().where("count > 1")
    if not twice.isEmpty():  # whole rows were repeated
        left = left.dropDuplicates(["_row", "_md5"])
    return left.select("_doc.*")
