import numpy as np
import pytest
from pyspark.sql import functions as F

from sizeladder.operators import curves, tables
from sizeladder.operators.prepare import empty_covariates, require_covariates
from sizeladder.operators.select import complete_columns, select_best, union_scores
from sizeladder.plans.experiments import canonical_runs, expand_experiments, validate_experiments
from sizeladder.sources.catalog import Catalog
from sizeladder.sources.files import number_rows, read_matrix, suffix_of


def scores(spark, rows, ddl):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "grid_index int, " + ddl)


def best(df):
    return [(r["n"], r["s"]) + tuple(r[c] for c in df.columns if c not in ("n", "s", "grid_index")) for r in
            select_best(df, []).orderBy("n", "s").collect()]


def test_best_rows(spark):
    ddl = "n int, s int, r2_val double, p string"
    df = scores(spark, [(100, 42, .8, "a"), (200, 43, .9, "b"), (100, 42, .7, "c"), (200, 43, .85, "d")], ddl)
    assert best(df) == [(100, 42, .8, "a"), (200, 43, .9, "b")]
    tie = scores(spark, [(100, 42, .8, "a"), (100, 42, .8, "b")], ddl)
    assert best(tie) == [(100, 42, .8, "a")]
    nan = scores(spark, [(100, 42, float("nan"), "a"), (100, 42, .1, "b"), (200, 42, None, "c")], ddl)
    assert best(nan) == [(100, 42, .1, "b")]
    assert select_best(df.drop("s"), []) is None and select_best(df.drop("r2_val"), []) is None


def test_mixed_metrics_prefer_r2_and_drop_gaps(spark):
    a = scores(spark, [(100, 1, .5)], "n int, s int, r2_val double")
    b = scores(spark, [(200, 1, .6)], "n int, s int, acc_val double").withColumn("r2_val", F.lit(0.4))
    out = complete_columns(select_best(union_scores([a, b]), []))
    assert set(out.columns) == {"grid_index", "n", "s", "r2_val"} and out.count() == 2


def points(spark, f, ns, sem=0.01):
    return spark.createDataFrame([("c", n, float(f(n)), sem, True) for n in ns], "run string, n int, y_mean double, y_sem double, mask boolean")


@pytest.mark.parametrize("a,b,c", [(-1.5, .45, .8), (-3.0, .9, .7), (-0.5, .05, 1.0), (-40.0, 2.5, .6)])
def test_power_law_is_recovered(spark, a, b, c):
    r = curves.fit_power_law(points(spark, lambda n: a * n ** -b + c, [32, 64, 128, 256, 512, 1024]), ["run"]).first()
    assert r["b"] == pytest.approx(b, abs=1e-4) and r["c"] == pytest.approx(c, abs=1e-4) and r["r2"] > 1 - 1e-9
    assert r["a"] <= 0 <= r["b"] and r["dof"] == 3


def test_falling_curve_is_flat(spark):
    ys = dict(zip([10, 20, 30, 40, 50], [.9, .85, .82, .8, .79]))
    r = curves.fit_power_law(points(spark, lambda n: ys[n], list(ys)), ["run"]).first()
    assert r["a"] == 0 and r["c"] == pytest.approx(np.mean(list(ys.values()))) and np.isfinite(r["chi2"])


def test_no_better_fit_on_a_fine_grid(spark):
    rng = np.random.RandomState(2)
    ns = np.array([32, 64, 128, 256, 512])
    y = -2 * ns ** -.4 + .8 + rng.normal(size=5) * .01
    r = curves.fit_power_law(points(spark, lambda n: y[list(ns).index(n)], [int(n) for n in ns]), ["run"]).first()
    mine = ((y - (r["a"] * ns ** -r["b"] + r["c"])) ** 2).sum()
    for b in np.linspace(1e-4, 10, 5000):
        u = ns ** -b
        A = np.stack([u, np.ones(5)], 1)
        w = np.linalg.lstsq(A, y, rcond=None)[0]
        if w[0] <= 0:
            assert mine <= ((y - A @ w) ** 2).sum() + 1e-9


def test_too_few_sizes(spark):
    df = spark.createDataFrame([(n, s, .5 + s / 100) for n in (10, 20) for s in range(5)], "n int, s int, r2_test double").withColumn("run", F.lit("c"))
    out = curves.statistics(df, ["run"], "r2_test", 10)
    fit = out["fit"].first()
    assert fit["dof"] == -1 and fit["a"] is None and fit["r2"] is None
    assert out["bootstrap"].count() == 0
    assert out["y"].where("mean is not null").count() == 0


def test_one_seed_masks_every_point(spark):
    df = spark.createDataFrame([("c", n, 0, .5) for n in (10, 20, 30, 40, 50)], "run string, n int, s int, r2_test double")
    assert not any(r["mask"] for r in curves.curve_points(df, ["run"], "r2_test").collect())


def test_bootstrap_repeats_itself_and_needs_enough_fits(spark):
    rng = np.random.RandomState(0)
    rows = [("c", n, s, float(-n ** -.5 + .8 + rng.normal() * .01)) for n in (32, 64, 128, 256, 512) for s in range(10)]
    df = spark.createDataFrame(rows, "run string, n int, s int, r2_test double")
    a = sorted(curves.bootstrap_fits(curves.bootstrap_points(df, ["run"], "r2_test", 30), ["run"]).collect())
    b = sorted(curves.bootstrap_fits(curves.bootstrap_points(df.repartition(5), ["run"], "r2_test", 30), ["run"]).collect())
    assert len(a) == 30 and np.allclose([r[1:] for r in a], [r[1:] for r in b])
    fits = curves.bootstrap_fits(curves.bootstrap_points(df, ["run"], "r2_test", 30), ["run"])
    assert curves.bootstrap_summary(fits, ["run"], 30).where("mean is null").count() == 0
    assert curves.bootstrap_summary(fits, ["run"], 600).where("mean is not null").count() == 0
    far = curves.extrapolate_to(fits, ["run"], [100000]).first()
    assert far["y_025"] <= far["y"] <= far["y_975"]


def test_run_keys(spark):
    good = "results/mnist/statistics/ridge-cls/pixel_ten-digits_none_none_False_True_default.stats.json"
    df = spark.createDataFrame([(good,)], "path string").select(tables.parse_run_key(F.col("path")).alias("k")).select("k.*")
    assert tuple(df.first()) == ("mnist", "ridge-cls", "pixel", "ten-digits", "none", "none", "False", "True", "default")
    bad = spark.createDataFrame([("results/mnist/statistics/ridge-cls/pixel_none.stats.json",)], "path string")
    with pytest.raises(Exception, match="Invalid filename structure"):
        bad.select(tables.parse_run_key(F.col("path")).alias("k")).select("k.*").collect()


def test_fit_lines_skip_missing_parameters(spark):
    f = spark.createDataFrame([("a", -1.0, .5, .8), ("b", None, .5, .8)], "run string, a double, b double, c double")
    lines = tables.fit_lines(f, ["run"], 1e5)
    assert lines.count() == 100 and lines.agg(F.min("n"), F.max("n")).first()[0] == pytest.approx(128)


def test_experiments(spark):
    e = spark.createDataFrame([("x", "d", ["a"], ["t"], ["matching", "none"], ["c", "none"], ["ridge-cls"], None, None, None)],
                              "experiment string, dataset string, features array<string>, targets array<string>, method array<string>, "
                              "cni array<string>, models array<string>, balanced boolean, quantile boolean, grid string")
    runs = expand_experiments(e)
    assert runs.count() == 4 and canonical_runs(runs).count() == 2
    catalog = spark.createDataFrame([("d", "features", "a"), ("d", "targets", "u")], "dataset string, role string, name string")
    models = spark.createDataFrame([("ridge-cls", False)], "model string, regression boolean")
    grids = spark.createDataFrame([("default", "ridge-cls")], "grid string, model string")
    messages = sorted(r["message"] for r in validate_experiments(e, catalog, models, grids).collect())
    assert messages == ["confound_correction_cni 'c' must exist in dataset 'd'", "target 't' must exist in dataset 'd'"]


def test_files(spark, tmp_path):
    m = np.arange(20.0).reshape(10, 2)
    np.save(tmp_path / "m.npy", m)
    got = read_matrix(spark, str(tmp_path / "m.npy")).orderBy("sample_id").collect()
    assert np.allclose([r["data"] for r in got], m)
    np.save(tmp_path / "f.npy", np.asfortranarray(m))
    np.save(tmp_path / "v.npy", np.arange(5, dtype="int32"))
    for path, want in ((tmp_path / "m.npy", m), (f"file:{tmp_path}/f.npy", m), (f"file://{tmp_path}/v.npy", np.arange(5.0)[:, None])):
        parts = spark.read.format("npy").option("rowsPerTask", 3).load(str(path)).orderBy("sample_id").collect()
        assert np.allclose([r["data"] for r in parts], want)
    with pytest.raises(ValueError, match="there are none"):
        require_covariates(empty_covariates(spark), "correct-x")
    (tmp_path / "m.csv").write_text("a,b\n" + "\n".join(f"{a},{b}" for a, b in m))
    df = number_rows(read_matrix(spark, str(tmp_path / "m.csv")))
    assert [tuple(r) for r in df.orderBy("sample_id").collect()] == [(i, *r) for i, r in enumerate(m)]
    with pytest.raises(ValueError, match="Unsupported file format"):
        suffix_of("m.xlsx")
    c = Catalog().add("d", "features", "m", str(tmp_path / "m.csv"))
    assert c.load(spark, "d", "features", "m").where("mask").count() == 10
    assert c.load(spark, "d", "covariates", "none").count() == 0
    c.add("d", "covariates", "lost", str(tmp_path / "lost.csv"))
    assert len(c.missing_files(spark)) == 1 and "lost.csv" in c.missing_files(spark)[0]
    with pytest.raises(KeyError):
        c.load(spark, "d", "features", "other")
