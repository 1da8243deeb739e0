"""Linear models on wide rows, against dense algebra and against the solver that forms the matrix."""

import numpy as np
import pytest

import sizeladder.operators.wide as wide
from sizeladder.operators.linear import fit_linear
from sizeladder.plans.models import MODELS

from test_models import CELL, long_rows, scaled


def rows_of(spark, x, y, seed=0):
    rows = [("r", len(y), seed, i, [float(v) for v in x[i]], float(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "run string, n int, seed int, sample_id bigint, x array<double>, y double")


def dense_values(x):
    z = scaled(x, len(x))
    return np.linalg.eigh(z.T @ z)


def finished(space, a):
    passes = 0
    while space.block.shape[1]:
        space.absorb(a @ space.block)
        passes += 1
    return space, passes


def test_principal_values_equal_dense_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 784)) @ (rng.normal(size=(784, 784)) * np.linspace(1, 0.01, 784)) + 1e3
    z = scaled(x, 500)
    values, vectors = np.linalg.eigh(z.T @ z)
    space, passes = finished(wide.Components(784, 20), z.T @ z)
    assert passes < 30
    assert list(space.values) == pytest.approx(values[::-1][:20], rel=1e-9)
    assert np.abs(np.abs((space.vectors * vectors[:, ::-1][:, :20]).sum(axis=0)) - 1).max() < 1e-8


def test_solutions_with_many_restarts():
    rng = np.random.default_rng(7)
    z = scaled(rng.normal(size=(150, 60)) * np.geomspace(1, 100, 60), 150)
    target = z.T @ rng.normal(size=(150, 2))
    space, passes = finished(wide.Solutions(target, [0.0, 0.01, 10.0], most=40), z.T @ z)
    assert passes > 4
    for penalty in (0.0, 0.01, 10.0):
        want = np.linalg.solve(z.T @ z + penalty * np.eye(60), target)
        assert np.abs(space.weights(penalty) - want).max() < 1e-8 * np.abs(want).max()


def test_stored_rows_give_the_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 40)) @ rng.normal(size=(40, 40)) + 1e3
    both = rows_of(spark, x, x[:, 0]).union(rows_of(spark, x[:90], x[:90, 0], seed=1))
    got = wide.principal(both, CELL, 6).orderBy("seed", "component").collect()
    assert [(r["seed"], r["component"]) for r in got] == [(s, c) for s in (0, 1) for c in range(1, 7)]
    want = np.concatenate([dense_values(x)[0][::-1][:6], dense_values(x[:90])[0][::-1][:6]])
    assert [r["value"] for r in got] == pytest.approx(want, rel=1e-9)


def test_components_beyond_the_rank_are_none(spark):
    rng = np.random.default_rng(2)
    x = np.hstack([rng.normal(size=(12, 60)), np.full((12, 1), 7.0)])
    x[-1] = x[0]  # repeated row
    got = wide.principal(rows_of(spark, x, x[:, 0]), CELL, 40).orderBy("component").collect()
    values, _ = dense_values(x)
    assert [r["value"] for r in got] == pytest.approx(values[::-1][:len(got)], abs=1e-8 * values[-1])
    assert len(got) >= 10


def test_more_components_than_a_block(monkeypatch):
    monkeypatch.setattr(wide, "BLOCK", 8)
    rng = np.random.default_rng(3)
    z = scaled(rng.normal(size=(300, 90)) @ rng.normal(size=(90, 90)), 300)
    space, _ = finished(wide.Components(90, 30), z.T @ z)
    assert list(space.values) == pytest.approx(np.linalg.eigvalsh(z.T @ z)[::-1][:30], rel=1e-9)


@pytest.mark.parametrize("shape, model, grid", [
    ((160, 40), "ols-reg", {}), ((48, 90), "ridge-reg", {"alpha": [1e-5, 0.1, 1e5]}), ((160, 40), "ridge-cls", {"alpha": [0.1, 100]}),
    ((48, 90), "pca-ridge-reg", {"pca__n_components": [2, 7, 30], "ridge__alpha": [0.1, 10]}),
    ((160, 40), "pca-ridge-cls", {"pca__n_components": [5], "ridge__alpha": [1]})])
def test_scores_equal_those_of_the_matrix(spark, monkeypatch, shape, model, grid):
    import sizeladder.operators.linear as linear
    rng = np.random.default_rng(4)
    x = rng.normal(size=shape) * np.linspace(1, 30, shape[1]) + 100
    x[:, 3] = 5.0
    y = x[:, :5] @ rng.normal(size=5) + rng.normal(size=shape[0])
    if model.endswith("cls"):
        y = np.digitize(y, np.quantile(y, [0.3, 0.7])).astype(float)
    long = long_rows(spark, x, y).union(long_rows(spark, x[::-1], y[::-1]).replace("r", "q", ["run"]))
    take = lambda: sorted((r["run"], r["grid_index"], *[r[c] for c in r.__fields__ if "_" in c and c != "grid_index"])
                          for r in MODELS[model].sweep(long, CELL, grid).collect())
    dense = take()
    monkeypatch.setattr(linear, "WIDE_FEATURES", 10)
    assert len(dense) == 2 * max(1, np.prod([len(v) for v in grid.values()]))
    for a, b in zip(dense, take(), strict=True):
        assert a[:2] == b[:2] and b[2:] == pytest.approx(a[2:], rel=1e-6, abs=1e-6)


def test_two_classes(spark, monkeypatch):
    import sizeladder.operators.linear as linear
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 60)) * np.geomspace(1, 100, 60)
    y = (x[:, 0] + rng.normal(size=150) > 0).astype(float)
    train = rows_of(spark, x, y)
    want = {r["grid_index"]: r for r in fit_linear(train, CELL, "ridge", {"alpha": [0.01, 10]}, True, classes=[0.0, 1.0]).collect()}
    monkeypatch.setattr(linear, "WIDE_FEATURES", 10)
    got = {r["grid_index"]: r for r in fit_linear(train, CELL, "ridge", {"alpha": [0.01, 10]}, True, classes=[0.0, 1.0]).collect()}
    for index, row in want.items():
        assert got[index]["coef"] == pytest.approx(row["coef"], rel=1e-6, abs=1e-9)
        assert got[index]["classes"] == [0.0, 1.0] and got[index]["params"] == row["params"]


def test_constant_target_empty_rows_and_the_bound(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(20, 15))
    schema = fit_linear(rows_of(spark, x, np.zeros(20)), CELL, "ridge", {"alpha": [1]}).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    row = wide.fit_wide(rows_of(spark, x, np.full(20, 3.0)), CELL, "ridge", {"alpha": [1]}, ddl).first()
    assert set(row["coef"]) == {0.0} and row["intercept"] == [3.0]
    assert wide.fit_wide(rows_of(spark, x, x[:, 0]).limit(0), CELL, "ridge", {"alpha": [1]}, ddl).count() == 0
    one = wide.fit_wide(rows_of(spark, x[:1], x[:1, 0]), CELL, "ridge", {"alpha": [1]}, ddl).first()
    assert set(one["coef"]) == {0.0}
    monkeypatch.setattr(wide, "BASIS_VALUES", 100)
    with pytest.raises(ValueError, match="BASIS_VALUES"):
        wide.principal(rows_of(spark, x, x[:, 0]), CELL, 3)
