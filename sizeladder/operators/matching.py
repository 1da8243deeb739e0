"""Covariate-matched splits: every minority case gets its nearest unused majority control.

Serving cases one after the other, each taking its nearest free control, needs at most the p + 1 nearest controls for the
case in place p. So only short candidate lists are ever built, by a nearest-neighbour join:

1. standardised covariates are cut into grids whose cells halve in width from level to level, and one scan of the pool counts
   its rows per finest cell, which gives the counts of all levels;
2. every case looks at the finest of its own cells that holds k rows or more, and so gets k controls and a radius;
3. at the level whose cells are as wide as that radius, it looks at the at most three cells per covariate within its reach.
   The k nearest of these are exact.

Cases and their cells are a table, sent to the pool while it has at most PROBE_ROWS rows and joined by shuffle beyond that,
with crowded cells split by a salt. The pool is cut to the cells that are looked at before anything of it moves, and each task
keeps the k best of what it finds per case. Of controls with the same covariates only the k first can be in a list; the others
are left out before.

Lists are resolved per split in priority order, in blocks of at most LIST_ENTRIES entries. A case whose list is used up stops the split
there; it and all later cases go into the next pass with longer lists. Cases before it are final. No list is cut short without
a later pass that completes it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_key
from ..schema import SAMPLE
from ..session import materialise, store
from .ranking import rank_by_draw
from .splits import Size, _size_array, drawn_samples, split_status, task_kind, undersample

PROBE_ROWS = 1_000_000   # (case, cell) rows sent to every task
SALT_ROWS = 200_000      # pool rows of a cell that one task joins
DIRECT_PAIRS = 2_000_000  # pairs of cases and controls below which cells are not worth their jobs
LIST_ENTRIES = 2_000_000        # candidate entries resolved in one group
GRID_COVARIATES, FINEST = 3, 20  # covariates that make up cells, and most halvings of the range


def inverse_spread(samples: DataFrame, run: list[str]) -> DataFrame:
    """1 / population variance per covariate over all rows; a constant covariate gets 1.

    Squared distances between standardised points need only this (the means cancel).
    """
    v = F.when(~F.isnan("v"), F.col("v"))
    return (samples.select(*run, F.posexplode("c").alias("i", "v"))
            .groupBy(*run, "i").agg(F.var_pop(v).alias("var"))
            .withColumn("w", F.when(F.col("var") > 0, 1.0 / F.col("var")).otherwise(F.lit(1.0)))
            .groupBy(*run).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))),
                                           lambda s: s["w"]).alias("weights")))


def _distance(weights: list[float]) -> Column:
    """Squared distance between `c` and `pc` in standardised units."""
    out = F.lit(0.0)
    for i, w in enumerate(weights):
        gap = F.col("c")[i] - F.col("pc")[i]
        out = out + gap * gap * F.lit(float(w))
    return out


def _cell(indices: list[Column], halvings: Column) -> Column:
    """Number of the cell at a level that is `halvings` coarser than the indices, as one bigint."""
    out = F.lit(0).cast("bigint")
    for i in indices:
        out = F.shiftleft(out, FINEST) + F.floor(i / F.pow(F.lit(2.0), halvings)).cast("bigint")
    return out


def _crossed(cells: Column, steps: Column) -> Column:
    """All cells with another index behind theirs."""
    return F.flatten(F.transform(cells, lambda o: F.transform(steps, lambda q: F.shiftleft(o, FINEST) + q)))


class _Grid:
    """Cells over the range of a pool, in units of its widest standardised covariate."""

    def __init__(self, pool: DataFrame, weights: list[float]):
        self.axes = list(range(min(len(weights), GRID_COVARIATES)))
        self.unit = [float(weights[i]) ** 0.5 for i in self.axes]
        ends = pool.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("c")[i]).alias(f"{f.__name__}_{i}") for i in self.axes for f in (F.min, F.max)]).first()
        self.rows = ends["n"]
        low, high = ([ends[f"{f}_{i}"] or 0.0 for i in self.axes] for f in ("min", "max"))
        self.low, self.high = low, high
        self.range = max((h - v) * u for v, h, u in zip(low, high, self.unit)) or 1.0
        bits = max(1, self.rows).bit_length()
        self.finest = max(1, min(FINEST, -(-bits // len(self.axes)) + 4))

    def index(self, c: Column) -> list[Column]:
        """Finest index per covariate; points outside the range count at its edge."""
        cells = 2 ** self.finest
        return [F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((c[i] - F.lit(v)) * F.lit(u * cells / self.range)))).cast("bigint")
                for i, v, u in zip(self.axes, self.low, self.unit)]

    def level(self, finest: list[Column], level: Column) -> Column:
        return _cell(finest, F.lit(self.finest) - level)

    def reach(self, c: Column, radius: Column, level: Column) -> Column:
        """Cells of a level within a radius of a point: at most three per covariate where cells are as wide as the radius."""
        cells = F.pow(F.lit(2.0), level)
        out = F.array(F.lit(0).cast("bigint"))
        for i, v, u in zip(self.axes, self.low, self.unit):
            place = (c[i] - F.lit(v)) * F.lit(u)
            ends = [F.greatest(F.lit(0), F.least(cells - 1, F.floor(e * cells / F.lit(self.range)))).cast("bigint") for e in (place - radius, place + radius)]
            out = _crossed(out, F.sequence(*ends))
        return out


def _look(probe: DataFrame, pool: DataFrame, grid: _Grid, counts: DataFrame | None, weights: list[float], k: int) -> DataFrame:
    """The k best controls (grp, case_id, control_id, dist, tie, place) per case in the cells (level, cell) of `probe`."""
    probe = store(probe, "probe")
    levels = [r["level"] for r in probe.select("level").distinct().collect()]  # at most FINEST + 1
    if not levels:
        levels = [0]
    cells = pool.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    cells = cells.select("grp", F.col(SAMPLE).alias("control_id"), "tie", F.col("c").alias("pc"), "level",
                         grid.level([F.col("ix")[i] for i in range(len(grid.axes))], F.col("level")).alias("cell"))
    keys = ["grp", "level", "cell"]
    if counts is None or probe.count() <= PROBE_ROWS:
        joined = cells.join(F.broadcast(probe), keys)
    else:
        # crowded cells are dealt over several tasks; they are few, as each has more than SALT_ROWS rows
        crowded = F.broadcast(store(counts.where(F.col("n") > SALT_ROWS).select(*keys, F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "crowded"))
        many = F.coalesce("salts", F.lit(1))
        asked = probe.join(crowded, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
        dealt = cells.join(crowded, keys, "left").withColumn("salt", F.pmod(F.xxhash64("control_id"), many).cast("int")).drop("salts")
        joined = dealt.join(asked, [*keys, "salt"])
    found = joined.select("grp", "case_id", "control_id", _distance(weights).alias("dist"), "tie").where(~F.isnan("dist"))
    best = Window.partitionBy("grp", "case_id").orderBy("dist", "tie", "control_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def nearest_controls(cases: DataFrame, pool: DataFrame, weights: list[float], k: int) -> DataFrame:
    """Top-k pool rows per case as (grp, case_id, control_id, dist, tie, place), ordered by (dist, tie, id).

    `cases` is (grp, sample_id, c), `pool` (grp, sample_id, tie, c); a case only sees its own group. Neither goes through
    the driver.
    """
    same = Window.partitionBy("grp", "c").orderBy("tie", SAMPLE)
    pool = pool.select("grp", SAMPLE, "tie", "c").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    grid = _Grid(pool, weights)
    pool = store(pool.withColumn("ix", F.array(*grid.index(F.col("c")))), "pool")
    cases = store(cases.select("grp", F.col(SAMPLE).alias("case_id"), "c").withColumn("ix", F.array(*grid.index(F.col("c")))), "cases")
    ix = [F.col("ix")[i] for i in range(len(grid.axes))]
    if cases.count() * grid.rows <= DIRECT_PAIRS:
        whole = cases.select("grp", "case_id", "c", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("cell"))
        return _look(whole, pool, grid, None, weights, k)
    every = F.explode(F.sequence(F.lit(0), F.lit(grid.finest)))
    finest = pool.groupBy("grp", "ix").agg(F.count(F.lit(1)).alias("n"))
    counts = store(finest.withColumn("level", every).groupBy("grp", "level", grid.level(ix, F.col("level")).alias("cell"))
                   .agg(F.sum("n").alias("n")), "counts")
    own = cases.withColumn("level", every).withColumn("cell", grid.level(ix, F.col("level")))
    full = own.join(counts.where(F.col("n") >= k), ["grp", "level", "cell"])
    level = full.groupBy("grp", "case_id").agg(F.max("level").alias("level"))
    start = cases.join(level, ["grp", "case_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    first = store(_look(start.select("grp", "case_id", "c", "level", grid.level(ix, F.col("level")).alias("cell")), pool, grid, counts, weights, k), "first")
    radius = first.groupBy("grp", "case_id").agg(F.sqrt(F.max("dist") * (1 + 1e-9)).alias("radius"))
    wide = F.floor(F.log2(F.lit(grid.range) / F.greatest(F.col("radius"), F.lit(1e-300))))
    around = (start.join(radius, ["grp", "case_id"]).where("level > 0")
              .withColumn("level", F.greatest(F.lit(0), F.least(F.lit(grid.finest), wide)).cast("int")))
    around = around.select("grp", "case_id", "c", "level", F.explode(grid.reach(F.col("c"), F.col("radius"), F.col("level"))).alias("cell"))
    # a case that started from the whole range has seen everything
    done = first.join(start.where("level = 0").select("grp", "case_id"), ["grp", "case_id"], "left_semi")
    return _look(around, pool, grid, counts, weights, k).unionByName(done)


def _resolve(key, table):
    """Serve the cases of one cell in priority order from their candidate lists.

    The number of rows is bounded by LIST_ENTRIES. A case without a list left is reported with a
    missing control, and so is everything after it.
    """
    frame = table.select(["prio", "case_id", "control_id", "dist", "place", "taken"]).to_pandas()
    frame = frame.sort_values(["prio", "place"], kind="stable")
    used, rows, blocked = set(), [], False
    for (prio, case), part in frame.groupby(["prio", "case_id"], sort=False):
        pick = None
        if not blocked:
            for control, dist, taken in zip(part["control_id"], part["dist"], part["taken"]):
                if not taken and control not in used:
                    pick = (int(control), float(dist))
                    break
            blocked = pick is None
        if pick:
            used.add(pick[0])
        rows.append((int(prio), int(case), pick[0] if pick else None, pick[1] if pick else None))
    n = len(rows)
    prio, case, control, dist = zip(*rows)
    keys = [pa.array([k.as_py()] * n, k.type) for k in key]
    return pa.Table.from_arrays(
        [*keys, pa.array(prio, pa.int64()), pa.array(case, pa.int64()), pa.array(control, pa.int64()),
         pa.array(dist, pa.float64())],
        names=["cell", "prio", "case_id", "control_id", "dist"])


def match_cases(cases: DataFrame, pool: DataFrame, weights: list[float], k: int = 8) -> DataFrame:
    """Exact greedy matching without replacement for all cells together.

    `cases` is (cell, grp, prio, sample_id, c) with `prio` 1..m in every cell, `pool` is
    (grp, sample_id, tie, c). Returns (cell, prio, case_id, control_id, dist).
    """
    pending, left = cases, cases.count()
    pool_size = None
    matched = None
    while left:
        block = max(1, LIST_ENTRIES // k)
        first = pending.groupBy("cell").agg(F.min("prio").alias("_first"))  # one row per cell
        now = pending.join(F.broadcast(first), "cell").where(F.col("prio") < F.col("_first") + block).drop("_first")
        lists = nearest_controls(now.select("grp", SAMPLE, "c").distinct(), pool, weights, k)
        offers = (now.select("cell", "grp", "prio", F.col(SAMPLE).alias("case_id"))
                  .join(lists, ["grp", "case_id"], "left"))
        if matched is None:
            offers = offers.withColumn("taken", F.lit(False))
        else:
            held = matched.select("cell", "control_id", F.lit(True).alias("_held"))
            offers = (offers.join(held, ["cell", "control_id"], "left")
                      .withColumn("taken", F.coalesce("_held", F.lit(False))).drop("_held"))
        done = store(offers.groupBy("cell").applyInArrow(
            _resolve, "cell INT, prio BIGINT, case_id BIGINT, control_id BIGINT, dist DOUBLE")
            .where("control_id is not null"), "matched")
        served = done.count()
        matched = done if matched is None else matched.unionByName(done)
        left -= served
        if left:
            if pool_size is None:
                pool_size = pool.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
            if k >= pool_size and not served:
                raise ValueError("The majority class is too small to match every case.")
            pending = store(pending.join(done.select("cell", "prio"), ["cell", "prio"], "left_anti"), "pending")
            k = min(4 * k, max(pool_size, 1))
    return matched


def matched_splits(samples: DataFrame, sizes: list[Size], seeds: list[int], run: list[str],
                   balanced: bool = False, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Matched splits and status (with the mean matching distance) for one run at a time.

    `samples` is (run..., sample_id, y, c, valid).
    """
    full = samples.withColumn("y", F.col("y").cast("double"))
    usable = full.where("valid")
    kinds = materialise(task_kind(usable.select(*run, SAMPLE, "y"), run, "matching", True, balanced))
    status = split_status(kinds, run, sizes, seeds, "matching")
    spread = inverse_spread(full, run)
    runs = [r.asDict() for r in kinds.join(spread, run).select(*run, "minority", "weights", "binary").collect()
            if r["binary"]]  # one row per run
    splits, means = None, None
    for r in runs:
        here = usable
        for column in run:
            here = here.where(F.col(column) == F.lit(r[column]))
        s, m = _match_one(here, full.sparkSession, kinds, status, sizes, seeds, run, r, balanced, k)
        splits = s if splits is None else splits.unionByName(s)
        means = m if means is None else means.unionByName(m)
    if splits is None:
        splits = usable.select(*run, F.lit(0).alias("n"), F.lit(0).alias("seed"), SAMPLE,
                               F.lit("train").alias("set")).limit(0)
        return splits, status.withColumn("average_matching_score", F.lit(None).cast("double"))
    return splits, status.join(means, [*run, "n", "seed"], "left")


def _match_one(here, spark, kinds, status, sizes, seeds, run, r, balanced, k):
    drawn = drawn_samples(here, run, seeds, ("c",))
    if balanced:
        drawn = undersample(drawn, kinds, run)
    minority, majority = r["minority"], 1.0 - r["minority"]
    keyed = (drawn.where(F.col("y") == minority)
             .withColumn("_key", draw_key("split", F.col("seed"), F.col(SAMPLE))))
    halves = [Size(s.n // 2, s.n_val // 2, s.n_test // 2) for s in sizes]
    ranked = rank_by_draw(keyed, [*run, "seed"], "_key", SAMPLE, max(h.total for h in halves))
    # train cases are served first, then validation, then test; inside a set by rank
    named = F.array(*[F.struct(F.lit(s.n).alias("n"), F.lit(h.n).alias("h"), F.lit(h.n_val).alias("hv"),
                               F.lit(h.n_test).alias("ht")) for s, h in zip(sizes, halves)])
    rank, h, hv, ht = F.col("rank"), F.col("h"), F.col("hv"), F.col("ht")
    in_set = F.when(rank <= ht, "test").when(rank <= ht + hv, "val").otherwise("train")
    served = (F.when(rank <= ht, h + hv + rank).when(rank <= ht + hv, h + rank - ht).otherwise(rank - ht - hv))
    cells = (ranked.select(*run, "seed", SAMPLE, "c", "rank", F.inline(named))
             .where(rank <= h + hv + ht)
             .withColumn("set", in_set).withColumn("prio", served.cast("bigint")))
    good = F.broadcast(status.where("error is null").select(*run, "n", "seed"))
    cells = cells.join(good, [*run, "n", "seed"], "left_semi")
    index = {(s.n, seed): i for i, (s, seed) in enumerate((s, e) for s in sizes for e in seeds)}
    number = F.create_map(*[F.lit(x) for pair in ((f"{n}:{e}", i) for (n, e), i in index.items()) for x in pair])
    cells = cells.withColumn("cell", number[F.concat_ws(":", "n", "seed")])
    # without balancing all seeds share one pool
    group = (F.col("seed") if balanced else F.lit(0)).cast("int")
    cases = store(cells.withColumn("grp", group), "cases")
    pool = ((drawn if balanced else here).where(F.col("y") == majority)
            .select(group.alias("grp"), SAMPLE, draw_key("tie", F.col(SAMPLE)).alias("tie"), "c"))
    found = match_cases(cases.select("cell", "grp", "prio", SAMPLE, "c"), pool, r["weights"], k)
    if found is None:
        empty = cases.select(*run, "n", "seed", SAMPLE, "set").limit(0)
        return empty, empty.groupBy(*run, "n", "seed").agg(F.lit(None).cast("double").alias("average_matching_score"))
    pairs = cases.join(found, ["cell", "prio"])
    both = pairs.select(*run, "n", "seed", "set",
                        F.explode(F.array(F.col(SAMPLE), F.col("control_id"))).alias(SAMPLE))
    means = pairs.groupBy(*run, "n", "seed").agg(F.avg("dist").alias("average_matching_score"))
    return both.select(*run, "n", "seed", SAMPLE, "set"), means
