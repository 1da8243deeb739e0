"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


#: Neighbours of one node that are joined together; nodes with more are dealt over several parts.
PART_ROWS = 200
#: Most nodes that can be hubs: the bound of the broadcast table of hubs.
MOST_HUBS = 100_000


def _least_around(rows: DataFrame, part_rows: int) -> DataFrame:
    """(a, b, m) for rows (a, b): m is the smallest b of the node a, or a itself where that is smaller.

    A node with more than `part_rows` rows is a hub. Hubs are at most rows / `part_rows`, so their table is broadcast;
    a hub's rows go to as many parts as they fill, each with a copy of the hub's minimum, so no task joins a whole hub.
    """
    least = rows.groupBy("a").agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / part_rows).cast("int")
    hubs = least.where(F.col("_n") > part_rows).select(F.col("a").alias("_hub"), parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hubs), F.col("a") == F.col("_hub"), "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"))
    copies = least.select(F.col("a").alias("_a"), F.least("a", "_m").alias("m"),
                          F.explode(F.sequence(F.lit(0), parts - 1)).alias("_copy"))
    return dealt.join(copies, (F.col("a") == F.col("_a")) & (F.col("_part") == F.col("_copy"))).select("a", "b", "m")


def _large_star(edges: DataFrame, part_rows: int) -> DataFrame:
    """Every neighbour above a node points to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (_least_around(both, part_rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame, part_rows: int) -> DataFrame:
    """Every node, and its neighbours below, point to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    own = down.groupBy("a").agg(F.min("b").alias("b"))
    moved = _least_around(down, part_rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame, least_part: int = PART_ROWS) -> DataFrame:
    """(node, label): the smallest node of its component, for every node of edges (a, b); isolated nodes have no row.

    Each round is a stored table; the end is seen by counts and sums of hashes, so no edge goes to the driver.
    """
    now, seen = store(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    part_rows = max(least_part, 2 * now.count() // MOST_HUBS + 1)  # no round adds edges, so hubs stay within their bound
    while True:
        now = store(_small_star(_large_star(now, part_rows), part_rows), "edges")
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == seen or not n:
            break
        seen = (n, total)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
