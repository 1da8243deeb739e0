"""Labels of any kind, feature maps, offsets, several chunks, steep curves, sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sizeladder.operators import gram as g
from sizeladder.operators import mllib
from sizeladder.operators.curves import fit_power_law
from sizeladder.operators.grids import feasible_grid, grid_points
from sizeladder.operators.splits import class_counts
from sizeladder.plans.models import MODELS
from sizeladder.sources import files, results

CELL = ["n", "seed"]
LONG = "n int, seed int, sample_id long, set string, x array<double>, y double"


def clusters(spark, labels, per=40, width=3, seed=0):
    """Well separated clusters, one per label."""
    rng = np.random.RandomState(seed)
    centres = rng.normal(scale=8.0, size=(len(labels), width))
    rows = []
    for i in range(per * len(labels)):
        k = i % len(labels)
        x = centres[k] + rng.normal(size=width)
        rows.append((per, 0, i, ("train", "train", "val", "test")[(i // len(labels)) % 4], [float(v) for v in x], float(labels[k])))
    return spark.createDataFrame(rows, LONG)


@pytest.mark.parametrize("model, grid", [("logistic-regression-cls", {}), ("random-forest-cls", {"n_estimators": [10], "max_depth": [5]}),
                                         ("xgb-cls", {"n_estimators": [10], "max_depth": [3]}), ("rbf-kernel-svm-cls", {"C": [100.0], "gamma": [0.1]}),
                                         ("ridge-cls", {"alpha": [0.1]})])
@pytest.mark.parametrize("labels", [(-1, 1), (3, 7, 9)])
def test_labels_of_any_kind(spark, model, grid, labels):
    s = MODELS[model].sweep(clusters(spark, labels), CELL, grid).first()
    assert s["acc_test"] > 0.9 and s["acc_train"] > 0.9


def test_forest_of_more_than_a_hundred_classes(spark):
    labels = [1000 + 3 * k for k in range(150)]
    s = MODELS["random-forest-cls"].sweep(clusters(spark, labels, per=16, width=6), CELL, {"n_estimators": [10], "max_depth": [12]}).first()
    assert s["acc_train"] > 0.5


def test_boosting_keeps_going_and_holds_rows_back(spark):
    long = clusters(spark, (0, 1), per=8).where("sample_id < 16")
    s = MODELS["xgb-cls"].sweep(long, CELL, {"n_estimators": [5], "max_depth": [2]}).first()
    assert s["acc_train"] is not None


@pytest.mark.parametrize("degree, features", [(1, 256), (2, 256), (3, 256), (2, 4096), (3, 20000)])
def test_polynomial_map_is_the_kernel(spark, degree, features):
    """Exact where the monomials fit, on average otherwise, in the same scale."""
    rng = np.random.RandomState(1)
    x = rng.normal(size=(12, 30 if features > 4096 else 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    z = np.array([r["x"] for r in mllib.polynomial(df, degree, x.shape[1], features if features < 20000 else 4000).orderBy("id").collect()])
    kernel = (x @ x.T / x.shape[1]) ** degree
    tolerance = 1e-9 if features < 20000 else 1.0
    assert np.abs(z @ z.T - kernel).max() < tolerance * max(1.0, np.abs(kernel).max())


def test_feasible_grid_names_what_was_used():
    grid = feasible_grid({"pca__n_components": [10, 20, 50], "ridge__alpha": [1.0, 2.0], "max_depth": [5, 30, 100]}, 16)
    assert grid == {"pca__n_components": [10, 16], "ridge__alpha": [1.0, 2.0], "max_depth": [5, 30, 100]}
    assert len(grid_points(grid)) == 12 and grid_points([{"a": 1}]) == [{"a": 1}]


@pytest.mark.parametrize("offset, spread", [(0.0, 1.0), (1.7e9, 1000.0), (1e6, 0.5)])
def test_several_chunks_and_offsets(spark, monkeypatch, offset, spread):
    monkeypatch.setattr(g, "CHUNK_ROWS", 50)
    monkeypatch.setattr(g, "HELD_VALUES", 20)
    rng = np.random.RandomState(4)
    x = np.column_stack([offset + spread * rng.normal(size=400), np.full(400, 7.25), rng.normal(size=400)])
    df = spark.createDataFrame([(400, 0, i, [float(v) for v in r], float(i % 5)) for i, r in enumerate(x)],
                               "n int, seed int, sample_id long, x array<double>, y double").repartition(6)
    chunk, chunks = g.chunk_of(F.col("n"))
    assert df.select(chunk.alias("c")).distinct().count() == 8
    both = np.column_stack([x, np.arange(400) % 5])
    for table in (g.gram(df, CELL, ["x", "y"], chunk, chunks), g.table_gram(df, CELL, ["x", "y"])):
        m = g.gram_matrix(table.select("i", "row").toArrow())
        want = np.cov(both.T, bias=True) * 400
        assert m[0, 0] == 400 and np.allclose(m[0, 1:], both.mean(0), rtol=1e-12)
        assert np.allclose(m[1:, 1:], want, rtol=1e-6, atol=1e-6 * spread) and m[2, 2] == 0.0


def test_wide_rows_make_smaller_chunks():
    spans = [g.CHUNK_VALUES // w for w in (1, 784, 10_000)]
    assert min(spans[0], g.CHUNK_ROWS) == g.CHUNK_ROWS and spans[1] < g.CHUNK_ROWS and spans[2] == 2000


def test_counts_of_many_classes(spark):
    df = spark.range(1000).select(F.lit("r").alias("run"), (F.col("id") % 200).cast("double").alias("y"))
    assert [r["cnt"] for r in class_counts(df, ["run"]).collect()] == [5] * 200


def test_steep_power_law(spark):
    """An exponent far above ten, and one so steep that only the first size differs."""
    for b in (14.0, 35.0):
        rows = [("r", n, -2.0 * (n / 10) ** -b + 0.9, 0.01, True) for n in (10, 11, 12, 14, 20, 40)]
        fit = fit_power_law(spark.createDataFrame(rows, "run string, n int, y_mean double, y_sem double, mask boolean"), ["run"]).first()
        assert fit["b"] == pytest.approx(b, rel=1e-3) and fit["c"] == pytest.approx(0.9, abs=1e-6)


def test_score_files_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("r2_val,n,alpha\n0.5,10,1.0\nbroken,11,2.0\n")
    (tmp_path / "b.csv").write_text("n,l1_ratio,r2_val\n20,0.3,0.7\n")
    (tmp_path / "c.csv").write_text("")
    rows = results.read_scores_csv(spark, str(tmp_path / "*.csv"), "n INT, alpha DOUBLE, l1_ratio DOUBLE, r2_val DOUBLE").orderBy("n").collect()
    assert [(r["n"], r["alpha"], r["l1_ratio"], r["r2_val"]) for r in rows] == [(10, 1.0, None, 0.5), (11, 2.0, None, None), (20, None, 0.3, 0.7)]
    assert [r["unreadable"] for r in rows] == [None, "broken,11,2.0", None]


def test_text_files_without_order_are_refused(spark, tmp_path):
    spark.range(10).repartition(2).write.option("header", True).csv(str(tmp_path / "two.csv"))
    with pytest.raises(ValueError, match="no order"):
        files.number_rows(files.read_matrix(spark, str(tmp_path / "two.csv")))


def test_npy_append_and_overwrite(spark, tmp_path):
    from sizeladder.sources.npy import register
    register(spark)
    path = str(tmp_path / "m.npy")

    def write(k, mode):
        df = spark.range(100).select(F.col("id").alias("sample_id"), F.array(F.col("id") + k * 1000.0, F.lit(1.0)).alias("data"))
        df.repartitionByRange(3, "sample_id").sortWithinPartitions("sample_id").write.format("npy").mode(mode).save(path)

    def values():
        return [r["data"][0] for r in spark.read.format("npy").load(path).orderBy("sample_id").collect()]

    write(0, "append")
    write(1, "append")
    assert values() == [float(i) for i in range(100)] + [1000.0 + i for i in range(100)]
    write(2, "overwrite")
    assert values() == [2000.0 + i for i in range(100)]
    shards = sorted((tmp_path / "m.npy").iterdir())
    assert all(p.suffix == ".npy" for p in shards) and sum(len(np.load(p)) for p in shards) == 100
