import numpy as np
from pyspark.sql import functions as F

from sizeladder.operators.splits import make_sizes
from sizeladder.plans.pipeline import run_experiments
from sizeladder.sources.catalog import Catalog


def test_experiments_end_to_end(spark, tmp_path):
    """All confound methods on small files, then a second call that only adds a grid."""
    rng = np.random.RandomState(0)
    n = 400
    c = rng.normal(size=n)
    x = rng.normal(size=(n, 3)) + c[:, None]
    y = x @ [1.0, 2.0, 0.0] + rng.normal(size=n) * .5
    spark.createDataFrame([(i, *map(float, x[i])) for i in range(n)], "sample_id long, a double, b double, d double").write.parquet(str(tmp_path / "x.parquet"))
    for name, v in (("y", y), ("k", (y > 0.5).astype(float)), ("c", c)):
        spark.createDataFrame([(i, float(v[i])) for i in range(n)], "sample_id long, v double").write.parquet(str(tmp_path / f"{name}.parquet"))
    catalog = (Catalog().add("d", "features", "f", str(tmp_path / "x.parquet")).add("d", "targets", "y", str(tmp_path / "y.parquet"))
               .add("d", "targets", "k", str(tmp_path / "k.parquet")).add("d", "covariates", "c", str(tmp_path / "c.parquet")))
    ddl = ("experiment string, dataset string, features array<string>, targets array<string>, method array<string>, "
           "cni array<string>, models array<string>, balanced boolean, quantile boolean, grid string")
    e = spark.createDataFrame([
        ("reg", "d", ["f"], ["y"], ["correct-both", "with-cni", "none"], ["c"], ["ridge-reg"], None, None, None),
        ("cls", "d", ["f"], ["k"], ["matching"], ["c"], ["ridge-cls"], True, None, None)], ddl)
    grids = {"default": {"ridge-reg": {"alpha": [1.0]}, "ridge-cls": {"alpha": [1.0]}},
             "more": {"ridge-reg": {"alpha": [1.0, 5.0]}}}
    sizes, out = make_sizes([16, 24, 32, 48, 64]), str(tmp_path / "out")
    run_experiments(spark, catalog, e, sizes, [0, 1, 2], out, repeats=5, grids=grids)
    scores = spark.read.option("mergeSchema", True).parquet(out + "/scores")
    counts = {(r["method"], r["model"]): r["count"] for r in scores.groupBy("method", "model").count().collect()}
    assert counts == {("correct-both", "ridge-reg"): 15, ("with-cni", "ridge-reg"): 15, ("none", "ridge-reg"): 15, ("matching", "ridge-cls"): 15}
    fit = {r["method"]: r for r in spark.read.parquet(out + "/fit").collect()}
    assert fit["none"]["dof"] == 2 and fit["none"]["n_seeds"] == 3 and fit["none"]["a"] <= 0
    assert spark.read.parquet(out + "/status").where("error is not null").count() == 0
    mean = {r["method"]: r["m"] for r in scores.where("n = 64").groupBy("method").agg(F.avg("r2_test").alias("m")).collect()}
    assert mean["none"] > 0.8
    only = e.where("experiment = 'reg'").withColumn("method", F.array(F.lit("none"))).withColumn("grid", F.lit("more"))
    run_experiments(spark, catalog, only, sizes, [0, 1, 2], out, repeats=5, grids=grids)
    again = spark.read.option("mergeSchema", True).parquet(out + "/scores").where("method = 'none'")
    assert {(r["grid"]): r["count"] for r in again.groupBy("grid").count().collect()} == {"default": 15, "more": 30}


def small_catalog(spark, tmp_path, n=300):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(n, 2))
    for name, v in (("x", x[:, 0]), ("y", x[:, 0] * 2 + rng.normal(size=n)), ("short", x[:-5, 1])):
        rows = [(i, float(v[i])) for i in range(len(v))]
        spark.createDataFrame(rows, "sample_id long, v double").write.parquet(str(tmp_path / f"{name}.parquet"))
    return (Catalog().add("d", "features", "f", str(tmp_path / "x.parquet")).add("d", "targets", "y", str(tmp_path / "y.parquet"))
            .add("d", "targets", "short", str(tmp_path / "short.parquet")))


DDL = ("experiment string, dataset string, features array<string>, targets array<string>, method array<string>, "
       "cni array<string>, models array<string>, balanced boolean, quantile boolean, grid string")
GRID = {"default": {"ridge-reg": {"alpha": [1.0]}}}


def test_later_seeds_and_sizes_keep_earlier_ones(spark, tmp_path):
    catalog, out = small_catalog(spark, tmp_path), str(tmp_path / "out")
    e = spark.createDataFrame([("a", "d", ["f"], ["y"], ["none"], ["none"], ["ridge-reg"], None, None, None)], DDL)
    run_experiments(spark, catalog, e, make_sizes([16, 32]), [0, 1], out, repeats=5, grids=GRID)
    first = {(r["n"], r["s"]): r["r2_test"] for r in spark.read.parquet(out + "/scores").collect()}
    run_experiments(spark, catalog, e, make_sizes([32, 64]), [2], out, repeats=5, grids=GRID)
    both = {(r["n"], r["s"]): r["r2_test"] for r in spark.read.option("mergeSchema", True).parquet(out + "/scores").collect()}
    assert set(both) == {(16, 0), (16, 1), (32, 0), (32, 1), (32, 2), (64, 2)}
    assert all(both[k] == v for k, v in first.items())
    cells = {(r["n"], r["seed"]) for r in spark.read.parquet(out + "/splits").select("n", "seed").distinct().collect()}
    assert cells == set(both)


def test_configuration_and_alignment_are_checked_first(spark, tmp_path):
    import pytest
    catalog, out = small_catalog(spark, tmp_path), str(tmp_path / "out")
    bad = spark.createDataFrame([("a", "d", ["f"], ["nothing"], ["none"], ["none"], ["ridge-reg"], None, None, None)], DDL)
    with pytest.raises(ValueError, match="must exist in dataset"):
        run_experiments(spark, catalog, bad, make_sizes([16]), [0], out, grids=GRID)
    short = spark.createDataFrame([("a", "d", ["f"], ["short"], ["none"], ["none"], ["ridge-reg"], None, None, None)], DDL)
    with pytest.raises(AssertionError, match="Mismatch"):
        run_experiments(spark, catalog, short, make_sizes([16]), [0], out, grids=GRID)


def test_only_missing_points_are_fitted(spark, tmp_path, monkeypatch):
    from sizeladder.operators import linear
    from sizeladder.plans import models
    from sizeladder.plans.sweep import sweep
    fitted = []
    real = linear.fit_linear
    monkeypatch.setattr(models, "fit_linear", lambda train, cell, kind, grid, *a, **k: (fitted.append(grid), real(train, cell, kind, grid, *a, **k))[1])
    rng = np.random.RandomState(3)
    rows = [(n, 0, int(i), ("train", "val", "test")[i % 3], [float(v) for v in rng.normal(size=2)], float(rng.normal()))
            for n in (10, 20) for i in range(60)]
    long = spark.createDataFrame(rows, "n int, seed int, sample_id long, set string, x array<double>, y double")
    grid = {"alpha": [0.1, 1.0, 10.0]}
    whole = sweep(long, "ridge-reg", grid, [])
    stored = whole.where("grid_index = 0 or n = 10").withColumn("r2_val", F.lit(0.5))
    fitted.clear()
    got = sweep(long, "ridge-reg", grid, [], stored)
    assert [g for g in fitted] == [[{"alpha": 1.0}, {"alpha": 10.0}]]
    want = {(r["n"], r["grid_index"]): 0.5 if r["grid_index"] == 0 or r["n"] == 10 else r["r2_val"] for r in whole.collect()}
    assert {(r["n"], r["grid_index"]): r["r2_val"] for r in got.collect()} == want


def test_score_files_are_one_scan_per_header(spark, tmp_path):
    from sizeladder.sources.results import read_scores_csv
    for i in range(12):
        order = ["n", "r2_val", "alpha"] if i % 2 else ["alpha", "n", "r2_val"]
        row = {"n": str(i), "r2_val": "0.5" if i != 3 else "bad", "alpha": str(i / 2)}
        (tmp_path / f"f{i}.csv").write_text(",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n")
    (tmp_path / "nothing.csv").write_text("")
    df = read_scores_csv(spark, [str(p) for p in tmp_path.glob("*.csv")], "n int, alpha double, r2_val double, s int")
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 2
    rows = {r["n"]: r for r in df.collect()}
    assert len(rows) == 12 and all(r["alpha"] == n / 2 and r["s"] is None for n, r in rows.items())
    assert rows[3]["r2_val"] is None and "bad" in rows[3]["unreadable"] and rows[4]["unreadable"] is None
