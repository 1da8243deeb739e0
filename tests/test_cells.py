"""Models that are fitted cell by cell in tasks, against plain versions of the same definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sizeladder.operators import cells, kernels, logistic, rfe, trees
from sizeladder.operators.grids import grid_points
from sizeladder.plans.grids import GRIDS
from sizeladder.plans.models import MODELS

CELL = ["run", "n", "seed"]
LONG = "run string, n int, seed int, sample_id long, set string, x array<double>, y double"


def table(spark, x, y, seeds=(0,), run="r"):
    part = np.where(np.arange(len(y)) % 4 < 2, "train", np.where(np.arange(len(y)) % 4 == 2, "val", "test"))
    rows = [(run, int((part == "train").sum()), s, i, str(part[i]), [float(v) for v in x[i]], float(y[i])) for s in seeds for i in range(len(y))]
    return spark.createDataFrame(rows, LONG).repartition(4), part


def make(n=120, d=3, seed=0):
    rng = np.random.RandomState(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    return x, x[:, 0] * 2 + np.sin(2 * x[:, -1]) + rng.normal(size=n) * 0.2


# --- trees -------------------------------------------------------------------------------------------

def plain_tree(x, g, h, w, depth):
    """A tree as nested tuples: (feature, threshold, left, right) or the value of a leaf."""
    used = w > 0
    unit = ((g[used] ** 2 / w[used]).sum() * w[used].sum() - g[used].sum() ** 2) / h[used].sum()

    def part(m):
        return g[m].sum() ** 2 / h[m].sum()

    def grow(m, level):
        best = (0.0, None)
        if level < depth and unit > 0:
            for f in range(x.shape[1]):
                values = np.unique(x[m, f])
                for a, b in zip(values, values[1:]):
                    left = m & (x[:, f] <= a)
                    gain = round((part(left) + part(m & ~left) - part(m)) / unit, 9)
                    if gain > best[0]:
                        best = (gain, (f, (a + b) / 2))
        if best[1] is None:
            return g[m].sum() / h[m].sum()
        f, cut = best[1]
        return (f, cut, grow(m & (x[:, f] <= cut), level + 1), grow(m & (x[:, f] > cut), level + 1))

    return grow(used, 0)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_grove_grows_plain_trees(depth):
    x, y = make(80)
    rng = np.random.RandomState(1)
    weights = rng.randint(0, 3, (4, len(y))).astype(float)
    h = weights * rng.uniform(0.5, 1.5, (4, len(y)))
    g = weights * (y + rng.normal(size=(4, len(y))))
    grove = trees.Grove(trees.Features(x), g[:, :, None], h, weights, np.full(4, depth), np.full(4, 3), np.arange(4, dtype=np.uint64)).grow()
    got = grove.predictions()[:, :, 0]
    for t in range(4):
        tree = plain_tree(x, g[t], h[t], weights[t], depth)
        assert np.allclose(got[t], [plain_value(tree, r) for r in x])


def evaluate(nodes, x):
    """Value of a tree table at rows."""
    nodes = {n["node"]: n for n in nodes}
    out = []
    for row in x:
        n = nodes[0]
        while n["feature"] is not None:
            n = nodes[n["left"] if row[n["feature"]] <= n["threshold"] else n["right"]]
        out.append(n["value"])
    return np.array(out)


@pytest.mark.parametrize("kind", ["reg", "two", "three"])
def test_boosting_is_the_sum_of_its_trees_and_stops(spark, kind):
    x, y = make(200)
    if kind != "reg":
        y = (y > 0).astype(float) + (3.0 if kind == "two" else (y > 1.5).astype(float))
    long, part = table(spark, x, y, seeds=(0, 1))
    grid = {"n_estimators": [400], "max_depth": [2, 3], "learning_rate": [0.5], "subsample": [0.7], "max_features": [0.5]}
    name = "xgb-reg" if kind == "reg" else "xgb-cls"
    nodes = [r.asDict() for r in trees.tree_tables(long, name, grid, CELL).where("seed = 1").collect()]
    got = {(r["grid_index"], r["sample_id"]): r["yhat"] for r in trees.tree_predictions(long, name, grid, CELL).where("seed = 1").collect()}
    scores = {(r["seed"], r["grid_index"]): r for r in trees.sweep_trees(long, name, grid, CELL).collect()}
    assert set(scores) == {(s, i) for s in (0, 1) for i in (0, 1)}
    classes, train = np.unique(y), part == "train"
    for i in (0, 1):
        mine = [n for n in nodes if n["grid_index"] == i]
        rounds = max(n["round"] for n in mine) + 1
        assert 10 < rounds < 400  # ended by the held-back rows
        outputs = max(n["output"] for n in mine) + 1
        f = np.stack([sum(evaluate([n for n in mine if n["round"] == r and n["output"] == k], x)[:, 0] for r in range(rounds)) for k in range(outputs)])
        yhat = np.array([got[i, j] for j in range(len(y))])
        if kind == "reg":
            start = (yhat - y[train].mean()) / y[train].std() - f[0]
            assert np.allclose(start, start[0])  # all rows start from one value
            metric = 1 - ((y - yhat)[train] ** 2).sum() / ((y - y[train].mean())[train] ** 2).sum()
            assert scores[1, i]["r2_train"] == pytest.approx(metric)
        else:
            ranked = np.array([f[:, yhat == c].max(axis=1) for c in classes]) if outputs == 1 else None
            if outputs == 1:
                assert f[0, yhat == classes[0]].max() < f[0, yhat == classes[1]].min() and ranked is not None
            assert scores[1, i]["acc_train"] == pytest.approx((yhat == y)[train].mean()) and scores[1, i]["acc_train"] > 0.85


def test_stopping_rule():
    """Ten rounds are kept in mind: the first whose loss is not below the worst of them ends it."""
    x, y = make(100, seed=3)
    rng = np.random.RandomState(0)
    stop, boot = rng.randint(0, 2 ** 60, 100), np.arange(100)
    cell = cells.Cell(x, rng.permutation(y), np.array(["train"] * 100, dtype=object), stop, boot, None)
    rows = []
    trees.boost(cell, [{"n_estimators": 500, "max_depth": 3, "learning_rate": 0.3}], lambda p, r, k, node, f, cut, a, b, v: rows.append((r, node, f, cut, a, b, v)))
    rounds = max(r for r, *_ in rows) + 1
    score, losses = np.full(100, cell.target[cell.fit].mean()), []
    for r in range(rounds):
        nodes = [dict(zip(("node", "feature", "threshold", "left", "right", "value"), n[1:])) for n in rows if n[0] == r]
        score = score + evaluate(nodes, cell.x)[:, 0]
        losses.append(((cell.target - score)[cell.held] ** 2).mean())
    fine = [i < 10 or losses[i] + 1e-4 < max(losses[i - 10:i]) for i in range(rounds)]
    assert all(fine[:-1]) and not fine[-1] and rounds < 500


@pytest.mark.parametrize("kind", ["reg", "cls"])
def test_forest_averages_plain_trees_of_any_depth(spark, kind):
    x, y = make(60, seed=4)
    y = y if kind == "reg" else np.digitize(y, [-0.5, 1.0]).astype(float)
    long, part = table(spark, x, y)
    grid = {"n_estimators": [4], "max_depth": [2, 100], "max_features": [1.0]}
    got = {(r["grid_index"], r["sample_id"]): r["yhat"] for r in trees.tree_predictions(long, f"random-forest-{kind}", grid, CELL).collect()}
    from sizeladder.functions.draws import draw_key
    boot = {r["sample_id"]: r["b"] for r in long.select("sample_id", draw_key("boot", F.col("sample_id")).alias("b")).collect()}
    order = sorted((i for i in range(len(y)) if part[i] == "train"), key=lambda i: boot[i])
    for i, depth in enumerate((2, 100)):
        total = 0
        for t in range(4):
            w = np.zeros(len(y))
            w[order] = trees.bootstrap_counts(t, len(order))
            if kind == "reg":
                tree = plain_tree(x, w * y, w, w, depth)
                total = total + np.array([plain_value(tree, r) for r in x])
        if kind == "reg":
            assert np.allclose([got[i, j] for j in range(len(y))], total / 4)
        else:
            assert np.mean([got[i, j] == y[j] for j in range(len(y)) if part[j] == "train"]) > (0.6 if depth == 2 else 0.9)


def test_few_features_are_tried_but_nodes_still_split():
    x = np.zeros((40, 20))
    x[:, 7] = np.arange(40)
    grove = trees.Grove(trees.Features(x), np.arange(40.0)[None, :, None], np.ones((1, 40)), np.ones((1, 40)), np.array([100]), np.array([1]),
                        np.zeros(1, dtype=np.uint64)).grow()
    assert np.allclose(grove.predictions()[0, :, 0], np.arange(40.0))  # one feature of twenty can split, and does to the end


def test_default_grids_are_whole(spark):
    x, y = make(48, seed=6)
    long, _ = table(spark, x, y)
    for name, points in (("random-forest-reg", 16), ("xgb-reg", 24)):
        rows = MODELS[name].sweep(long, CELL, GRIDS["default"][name]).collect()
        assert sorted(r["grid_index"] for r in rows) == list(range(points))
        assert {r["params"]["max_depth"] for r in rows} == set(map(float, GRIDS["default"][name]["max_depth"]))


def test_large_cells_go_over_the_cluster(spark):
    x, y = make(60)
    a, _ = table(spark, x, (y > 0).astype(float), run="small")
    b, _ = table(spark, np.tile(x, (2, 1)), np.tile(y > 0, 2).astype(float), run="large")
    rows = trees.sweep_trees(a.unionByName(b), "random-forest-cls", {"n_estimators": [5], "max_depth": [3]}, CELL, most=60 * 3).collect()
    assert {r["run"] for r in rows} == {"small", "large"} and all(r["acc_train"] > 0.7 for r in rows)


# --- machines ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["rbf", "poly"])
@pytest.mark.parametrize("c", [0.3, 20.0])
def test_machines_meet_their_conditions(kind, c):
    x, y = make(70, seed=7)
    k = kernels.kernel(kind, {"gamma": 0.2, "degree": 2}, x, x, 1.0)
    s = np.where(y > 0, 1.0, -1.0)[None]
    duals, bias = kernels.solve(k, s, -np.ones((1, 70)), np.array([c]))
    m, a = s[0] * (k @ duals[0] + bias[0]), np.abs(duals[0])
    assert abs(duals.sum()) < 1e-9 and a.max() <= c + 1e-12 and (s[0] * duals[0] >= -1e-12).all()
    assert (m[a == 0] > 1 - 2e-3).all() and (m[a >= c * (1 - 1e-9)] < 1 + 2e-3).all()
    inner = (a > 1e-9) & (a < c * (1 - 1e-9))
    assert np.abs(m[inner] - 1).max(initial=0) < 2e-3
    # no better dual objective along random feasible directions
    value = lambda d: np.abs(d).sum() - d @ k @ d / 2
    rng = np.random.RandomState(0)
    for _ in range(200):
        i, j = rng.choice(70, 2, replace=False)
        d = duals[0].copy()
        step = rng.uniform(-0.1, 0.1)
        d[i], d[j] = d[i] + step, d[j] - step
        if (s[0] * d >= 0).all() and np.abs(d).max() <= c:
            assert value(d) <= value(duals[0]) + 2e-3 * abs(step) + 1e-12


def test_regression_machine_on_a_line(spark):
    """Points within the tube of a line: the flattest line that keeps them there."""
    x = np.linspace(-1, 1, 80)[:, None]
    long, part = table(spark, x, 3 * x[:, 0] + 1)
    row = MODELS["poly-kernel-svm-reg"].sweep(long, CELL, {"C": [100.0], "degree": [1]}).first()
    duals = kernels.dual_tables(long, "poly-kernel-svm-reg", {"C": [100.0], "degree": [1]}, CELL).collect()
    assert row["r2_test"] > 0.98 and abs(sum(r["coef"] for r in duals)) < 1e-6
    z = (x[part == "train"][:, 0] - x[part == "train"].mean()) / x[part == "train"].std()
    ids = {int(i): v for i, v in zip(np.flatnonzero(part == "train"), z)}
    slope = sum(r["coef"] * ids[r["sample_id"]] for r in duals)
    assert slope == pytest.approx(1 - 0.1 / np.abs(z).max(), abs=2e-2)


def test_machines_vote_between_classes(spark):
    x, y = make(160, seed=8)
    labels = np.digitize(y, [-1.0, 1.0]) * 10.0
    long, part = table(spark, x, labels)
    rows = MODELS["rbf-kernel-svm-cls"].sweep(long, CELL, {"C": [1.0, 50.0], "gamma": [0.3]}).orderBy("grid_index").collect()
    assert len(rows) == 2 and rows[1]["acc_train"] > 0.9 and rows[1]["acc_test"] > 0.7
    duals = kernels.dual_tables(long, "rbf-kernel-svm-cls", {"C": [50.0], "gamma": [0.3]}, CELL).collect()
    train = part == "train"
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    votes = np.zeros((len(y), 3))
    for m, (p, q) in enumerate([(0, 1), (0, 2), (1, 2)]):
        mine = [r for r in duals if r["output"] == m]
        f = sum(r["coef"] * np.exp(-0.3 * ((z - z[r["sample_id"]]) ** 2).sum(axis=1)) for r in mine) + mine[0]["bias"]
        votes[:, p] += f > 0
        votes[:, q] += f <= 0
    assert rows[1]["acc_test"] == pytest.approx((np.array([0.0, 10.0, 20.0])[votes.argmax(axis=1)] == labels)[part == "test"].mean())


def test_one_class_only(spark):
    x, y = make(20)
    long, _ = table(spark, x, np.full(20, 7.0))
    for name, grid in (("rbf-kernel-svm-cls", {"C": [1.0]}), ("xgb-cls", {"n_estimators": [3]}), ("random-forest-cls", {"n_estimators": [3]}),
                       ("logistic-regression-cls", {})):
        assert MODELS[name].sweep(long, CELL, grid).first()["acc_test"] == 1.0


# --- logistic regression and elimination -------------------------------------------------------------

@pytest.mark.parametrize("classes, c", [(2, 1.0), (4, 1.0), (3, 1000.0)])
def test_logistic_gradient_vanishes(classes, c):
    rng = np.random.RandomState(2)
    x = rng.normal(size=(90, 5))
    label = rng.randint(0, classes, 90)
    w = logistic.optimise(x, label, 1 if classes == 2 else classes, c)
    z = w[:, 1:] @ x.T + w[:, :1]
    p = 1 / (1 + np.exp(-z)) if classes == 2 else np.exp(z) / np.exp(z).sum(axis=0)
    hit = (label == 1)[None] if classes == 2 else label == np.arange(classes)[:, None]
    assert np.abs(c * (p - hit) @ x + w[:, 1:]).max() < 1e-5 * max(1, c) and np.abs((p - hit).sum(axis=1)).max() < 1e-5


@pytest.mark.parametrize("classes", [None, [0.0, 1.0], [0.0, 1.0, 2.0]])
def test_both_eliminations_agree(spark, classes):
    x, y = make(100, d=6, seed=9)
    if classes:
        y = np.digitize(y, [0.0, 1.0][:len(classes) - 1]).astype(float)
    long, _ = table(spark, x, y, seeds=(0, 1))
    train = long.where("set = 'train'")
    read = lambda df: {(r["seed"], s["size"]): sorted(s["features"]) for r in df.collect() for s in r["supports"]}
    once = read(rfe.eliminate(train, CELL, [2, 4, 6], classes))
    assert once == read(rfe.eliminate(train, CELL, [2, 4, 6], classes, most=0)) and len(once) == 6
    assert math.prod(len(v) for v in once.values()) == (2 * 4 * 6) ** 2
    assert len(grid_points(GRIDS["default"]["rfe-ridge-reg"])) == 66
