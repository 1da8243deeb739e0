"""Learning curves: moments by size, bounded power-law fit, bootstrap, extrapolation.

A curve has one point per configured sample size, so its points travel as a short array and the fit is
a row-wise expression: no shuffle beyond the grouping of scores, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_integer
from ..functions.numeric import nan_to_null, power_law
from ..schema import MIN_DOF
from ..session import spread, store

# The search over the exponent looks at 10 (i / 40)^2, i = 0..40, then at 20 points in geometric steps up to
# the exponent that makes the second size equal to infinity in double precision (37 / ln(n_2 / n_1); any larger one
# gives the same curve), and narrows eight times by a factor of five around the best one.
B_FINE = 10.0
B_POINTS = 40
B_COARSE = 20
B_FLAT = 37.0
REFINEMENTS = 8
BOOTSTRAP_SEED = 42


def curve_points(best: DataFrame, run: list[str], metric: str) -> DataFrame:
    """Mean, sample spread, standard error and mask by size."""
    y = nan_to_null(F.col(metric).cast("double"))
    points = best.groupBy(*run, "n").agg(F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_std"),
                                         (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("y_sem"))
    return points.withColumn("mask", F.coalesce(F.col("y_mean") - F.col("y_sem") > 0, F.lit(False)))


def _let(value: Column, body) -> Column:
    """Name a value inside an expression, so that using it twice does not compute it twice."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))


def _fit_for(points: Column, size: Column, yy: Column, b: Column) -> Column:
    """Least squares of the centred y on v = 1 - (n / n_min)^-b with slope >= 0.

    `points` holds struct(l, y) with l = ln(n / n_min). expm1 keeps v exact for small b.
    """
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("vv"), F.lit(0.0).alias("vy"))
    pairs = F.transform(points, lambda p: F.struct((-F.expm1(-b * p["l"])).alias("v"), p["y"].alias("y")))
    sums = F.aggregate(pairs, zero, lambda s, p: F.struct(
        (s["v"] + p["v"]).alias("v"), (s["vv"] + p["v"] * p["v"]).alias("vv"), (s["vy"] + p["v"] * p["y"]).alias("vy")))

    def finish(s):
        spread = s["vv"] - s["v"] * s["v"] / size
        slope = F.when((spread > 1e-14 * s["vv"]) & (s["vy"] > 0), s["vy"] / spread).otherwise(F.lit(0.0))
        return F.struct((yy - slope * s["vy"]).alias("sse"), b.alias("b"), slope.alias("slope"),
                        (s["v"] / size).alias("vbar"))

    return _let(sums, finish)


def best_power_law(points: Column) -> Column:
    """struct(a, b, c, sse) of the fit with a <= 0 and b >= 0 for an array of struct(n, y, ...).

    For a given exponent the other two parameters are a closed form, so only the exponent is searched.
    """
    def centred(base):
        return F.transform(base["p"], lambda p: F.struct(F.log(p["n"] / base["first"]).alias("l"),
                                                         (p["y"] - base["mean"]).alias("y")))

    def top(base):
        later = F.filter(F.transform(base["p"], lambda p: F.log(p["n"] / base["first"])), lambda l: l > 0)
        return F.greatest(F.lit(B_FINE), F.lit(B_FLAT) / F.coalesce(F.array_min(later), F.lit(1.0)))

    def search(data):
        def at(b):
            return _fit_for(data["p"], data["size"], data["yy"], b)

        def narrow(best):
            half = (best["hi"] - best["lo"]) / 10
            tries = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: at(best["lo"] + half * i.cast("double")))
            return _let(F.array_min(tries), lambda w: F.struct(
                w.alias("fit"), F.greatest(w["b"] - half, F.lit(0.0)).alias("lo"), (w["b"] + half).alias("hi")))

        def coarse(i):
            fine = F.lit(B_FINE) * (i.cast("double") / B_POINTS) * (i.cast("double") / B_POINTS)
            return F.when(i <= B_POINTS, fine).otherwise(
                F.lit(B_FINE) * F.pow(data["top"] / B_FINE, (i.cast("double") - B_POINTS) / B_COARSE))

        last = F.lit(B_POINTS + B_COARSE)
        start = F.array_min(F.transform(F.sequence(F.lit(0), last),
                                        lambda i: F.struct(at(coarse(i)).alias("fit"), i.alias("i"))))
        best = _let(start, lambda w: F.struct(
            w["fit"].alias("fit"), coarse(F.greatest(w["i"] - 1, F.lit(0))).alias("lo"),
            coarse(F.least(w["i"] + 1, last)).alias("hi")))
        best = F.aggregate(F.sequence(F.lit(1), F.lit(REFINEMENTS)), best, lambda state, _: narrow(state))
        return _let(best["fit"], lambda f: F.struct(
            (-f["slope"] * F.pow(data["first"], f["b"])).alias("a"), f["b"].alias("b"),
            (data["mean"] + f["slope"] * (F.lit(1.0) - f["vbar"])).alias("c"), f["sse"].alias("sse")))

    base = F.struct(points.alias("p"), F.array_min(F.transform(points, lambda p: p["n"])).alias("first"),
                    (_total(points, lambda p: p["y"]) / F.size(points).cast("double")).alias("mean"))
    return _let(base, lambda g: _let(
        F.struct(centred(g).alias("p"), g["first"].alias("first"), g["mean"].alias("mean"),
                 F.size(g["p"]).cast("double").alias("size"), top(g).alias("top"),
                 _total(g["p"], lambda p: (p["y"] - g["mean"]) * (p["y"] - g["mean"])).alias("yy")), search))


def fit_power_law(points: DataFrame, run: list[str]) -> DataFrame:
    """One row per curve: dof, a, b, c, r2, chi2, mu, sigma from (run..., n, y_mean, y_sem, mask).

    Fewer than two degrees of freedom leave every parameter missing.
    """
    entry = F.struct(F.col("n").cast("double").alias("n"), F.col("y_mean").alias("y"), F.col("y_sem").alias("e"))
    curves = points.groupBy(*run).agg(
        F.array_sort(F.collect_list(F.when(F.col("mask"), entry))).alias("_p"))  # one entry per size
    curves = curves.withColumn("dof", (F.size("_p") - 3).cast("int"))
    fit = F.when(F.col("dof") >= MIN_DOF, best_power_law(F.col("_p")))
    # a generator keeps the optimiser from copying the fit into every expression that uses it
    curves = curves.select("*", F.inline_outer(F.array(fit))).drop("sse")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    count = F.size("_p").cast("double")
    residuals = F.transform("_p", lambda p: p["y"] - power_law(p["n"], a, b, c))
    relative = F.transform("_p", lambda p: (p["y"] - power_law(p["n"], a, b, c)) / F.nullif(p["e"], F.lit(0.0)))
    curves = (curves.withColumn("_r", residuals).withColumn("_z", relative)
              .withColumn("_ybar", _total(F.col("_p"), lambda p: p["y"]) / F.nullif(count, F.lit(0.0))))
    sse = _total(F.col("_r"), lambda r: r * r)
    sst = _total(F.col("_p"), lambda p: (p["y"] - F.col("_ybar")) * (p["y"] - F.col("_ybar")))
    mu = _total(F.col("_z"), lambda z: z) / F.nullif(count, F.lit(0.0))
    fitted = a.isNotNull()
    r2 = F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1.0 - sse / F.nullif(sst, F.lit(0.0)))
    sigma = _let(mu, lambda m: F.sqrt(_total(F.col("_z"), lambda z: (z - m) * (z - m)) / count))
    return curves.select(
        *run, "dof", "a", "b", "c", F.when(fitted, r2).alias("r2"),
        F.when(fitted, _total(F.col("_z"), lambda z: z * z) / F.col("dof")).alias("chi2"),
        F.when(fitted, mu).alias("mu"), F.when(fitted, sigma).alias("sigma"))


def bootstrap_points(best: DataFrame, run: list[str], metric: str, repeats: int,
                     seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Resampled means (run..., rep, n, y, mask): the seeds of each size are drawn with replacement.

    The scores of one size travel as one array (an entry per seed). The mask is that of the curve.
    """
    y = nan_to_null(F.col(metric).cast("double"))
    sizes = best.groupBy(*run, "n").agg(
        F.array_sort(F.collect_list(F.struct("s", y.alias("y")))).alias("_s"),
        F.avg(y).alias("_m"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("_e"))
    reps = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    count = F.size("_s")
    draws = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("_s")[
        draw_integer(count, F.lit(seed), F.col("rep"), F.col("n"), i).cast("int")]["y"])
    mean = F.aggregate(draws, F.lit(0.0), lambda acc, v: acc + v) / count
    return reps.select(*run, "rep", "n", mean.alias("y"),
                       F.coalesce(F.col("_m") - F.col("_e") > 0, F.lit(False)).alias("mask"))


def bootstrap_fits(points: DataFrame, run: list[str]) -> DataFrame:
    """(run..., rep, a, b, c), all repetitions in one job; curves that are too short are absent."""
    entry = F.struct(F.col("n").cast("double").alias("n"), F.col("y").alias("y"))
    curves = spread(points, *run, "rep").groupBy(*run, "rep").agg(F.array_sort(F.collect_list(
        F.when(F.col("mask") & F.col("y").isNotNull(), entry))).alias("_p"))
    long_enough = curves.where(F.size("_p") - 3 >= MIN_DOF)
    return long_enough.select(*run, "rep", F.inline(F.array(best_power_law(F.col("_p"))))).drop("sse")


def bootstrap_summary(fits: DataFrame, run: list[str], repeats: int) -> DataFrame:
    """Mean, spread and 95 % bounds of the parameters, long form (run..., parameter, ...).

    Missing unless more than 90 % of the repetitions gave a fit.
    """
    long = fits.select(*run, F.inline(F.array(*[F.struct(F.lit(k).alias("parameter"), F.col(k).alias("v"))
                                                for k in ("a", "b", "c")])))
    # at most `repeats` (5000) values per group
    agg = long.groupBy(*run, "parameter").agg(
        F.count("v").alias("n_fits"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.percentile("v", F.lit(0.975)).alias("p975"), F.percentile("v", F.lit(0.025)).alias("p025"))
    enough = F.col("n_fits") > F.lit(0.9 * repeats)
    return agg.select(*run, "parameter", "n_fits",
                      *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "std", "p975", "p025")])


def bootstrap_y_summary(points: DataFrame, run: list[str]) -> DataFrame:
    """The same for the resampled means of each size, without the 90 % rule, where a fit is possible."""
    dof = F.count_distinct(F.when(F.col("mask"), F.col("n"))) - 3
    fit = points.groupBy(*run).agg(dof.alias("dof"))
    out = points.groupBy(*run, "n").agg(
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"),
        F.percentile("y", F.lit(0.975)).alias("p975"), F.percentile("y", F.lit(0.025)).alias("p025"))
    ok = F.col("dof") >= MIN_DOF
    return (out.join(F.broadcast(fit), run)  # one row per curve
            .select(*run, "n", *[F.when(ok, F.col(c)).alias(c) for c in ("mean", "std", "p975", "p025")]))


def extrapolate_to(fits: DataFrame, run: list[str], sizes: list[int]) -> DataFrame:
    """Expected performance and 95 % interval at sample sizes that were not measured."""
    at = fits.withColumn("n", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    y = power_law(F.col("n"), F.col("a"), F.col("b"), F.col("c"))
    return at.withColumn("_y", y).groupBy(*run, "n").agg(
        F.avg("_y").alias("y"), F.stddev_pop("_y").alias("y_std"),
        F.percentile("_y", F.lit(0.975)).alias("y_975"), F.percentile("_y", F.lit(0.025)).alias("y_025"))


def statistics(best: DataFrame, run: list[str], metric: str, repeats: int = 100,
               seed: int = BOOTSTRAP_SEED) -> dict[str, DataFrame]:
    """All tables of a curve from its best scores."""
    points = curve_points(best, run, metric)
    resampled = bootstrap_points(best, run, metric, repeats, seed)
    fits = store(bootstrap_fits(resampled, run), "bootstrap")
    seeds = best.groupBy(*run).agg(F.count_distinct("s").alias("n_seeds"))
    return {"points": points, "fit": fit_power_law(points, run).join(seeds, run), "bootstrap": fits,
            "parameters": bootstrap_summary(fits, run, repeats), "y": bootstrap_y_summary(resampled, run)}
