import numpy as np
import pytest
from pyspark.sql import functions as F

from sizeladder.operators.confounds import regress_out
from sizeladder.operators.linear import fit_linear
from sizeladder.operators.prepare import feature_mode, prepare, require_valid, with_mask
from sizeladder.operators.quantile import interpolate, quantile_transform
from sizeladder.operators.rfe import eliminate
from sizeladder.plans.models import MODELS
from sizeladder.plans.sweep import sweep

CELL = ["run", "n", "seed"]
NAN = float("nan")


def long_rows(spark, x, y, n=None):
    m = len(y)
    kind = ["train"] * (m // 2) + ["val"] * (m // 4) + ["test"] * (m - m // 2 - m // 4)
    rows = [("r", n or m // 2, 0, i, kind[i], [float(v) for v in x[i]], float(y[i])) for i in range(m)]
    return spark.createDataFrame(rows, "run string, n int, seed int, sample_id bigint, set string, x array<double>, y double")


def data(m=240, d=6, seed=0):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(m, d)) * np.arange(1, d + 1) + 5
    w = rng.normal(size=d)
    return x, x @ w + rng.normal(size=m)


def scaled(x, k):
    m, s = x[:k].mean(0), x[:k].std(0)
    return (x - m) / np.where(s > 0, s, 1)


def ridge(z, y, k, alpha):
    zc, yc = z[:k] - z[:k].mean(0), y[:k] - y[:k].mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    return (z - z[:k].mean(0)) @ w + y[:k].mean()


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_equals_dense_solution(spark, monkeypatch):
    import sizeladder.operators.gram as g
    monkeypatch.setattr(g, "CHUNK_ROWS", 50)  # several chunks per cell
    x, y = data()
    got = {r["params"]["alpha"]: r for r in MODELS["ridge-reg"].sweep(long_rows(spark, x, y), CELL, {"alpha": [0.1, 10.0]}).collect()}
    for alpha, row in got.items():
        p = ridge(scaled(x, 120), (y - y[:120].mean()) / y[:120].std(), 120, alpha) * y[:120].std() + y[:120].mean()
        assert row["r2_val"] == pytest.approx(r2(y[120:180], p[120:180]), abs=1e-9)
        assert row["mae_test"] == pytest.approx(np.abs(y[180:] - p[180:]).mean(), rel=1e-9)


def test_ols_with_collinear_and_constant_columns(spark):
    x, y = data(d=3)
    x = np.hstack([x, x[:, :1] * 2, np.full((len(y), 1), 7.0)])
    row = MODELS["ols-reg"].sweep(long_rows(spark, x, y), CELL, {}).first()
    z = np.hstack([x[:, :3], np.ones((len(y), 1))])
    w = np.linalg.lstsq(z[:120], y[:120], rcond=None)[0]
    assert row["r2_test"] == pytest.approx(r2(y[180:], (z @ w)[180:]), abs=1e-8)


@pytest.mark.parametrize("classes", [2, 3])
def test_ridge_classifier(spark, classes):
    x, s = data(d=4)
    y = np.digitize(s, np.quantile(s, np.arange(1, classes) / classes)).astype(float)
    row = MODELS["ridge-cls"].sweep(long_rows(spark, x, y), CELL, {"alpha": [1.0]}).first()
    z = scaled(x, 120)
    scores = np.stack([ridge(z, np.where(y == c, 1.0, -1.0), 120, 1.0) for c in range(classes)], axis=1)
    want = scores.argmax(1) if classes > 2 else (scores[:, 1] > 0)
    assert row["acc_test"] == pytest.approx((want == y)[180:].mean())
    f1, total = 0.0, 0
    for c in range(classes):
        t, p = y[180:] == c, want[180:] == c
        f1 += t.sum() * 2 * (t & p).sum() / max(1, t.sum() + p.sum())
        total += t.sum()
    assert row["f1_test"] == pytest.approx(f1 / total)


def test_pca_ridge(spark):
    x, y = data()
    rows = MODELS["pca-ridge-reg"].sweep(long_rows(spark, x, y), CELL, {"pca__n_components": [2, 50], "ridge__alpha": [1.0]}).collect()
    z, ys = scaled(x, 120), (y - y[:120].mean()) / y[:120].std()
    u, s, vt = np.linalg.svd(z[:120] - z[:120].mean(0), full_matrices=False)
    for row in rows:
        k = int(min(row["params"]["pca__n_components"], 6))
        p = ridge(z @ vt[:k].T, ys, 120, 1.0) * y[:120].std() + y[:120].mean()
        assert row["r2_test"] == pytest.approx(r2(y[180:], p[180:]), abs=1e-8)


def test_elimination_equals_brute_force(spark):
    x, y = data(d=5, seed=3)
    y = x[:, 1] * 3 + x[:, 3] + np.random.RandomState(5).normal(size=len(y))
    long = long_rows(spark, x, y)
    got = {s["size"]: s["features"] for s in eliminate(long.where("set = 'train'"), CELL, [2, 4]).first()["supports"]}
    z, yc = scaled(x, 120)[:120], y[:120] - y[:120].mean()
    active, want = list(range(5)), {}
    while True:
        if len(active) in (2, 4):
            want[len(active)] = list(active)
        if len(active) == 2:
            break
        za, best = z[:, active], None
        for a in (0.1, 1.0, 10.0):
            inv = np.linalg.inv(za.T @ za + a * np.eye(len(active)))
            w = inv @ za.T @ yc
            h = np.einsum("ij,jk,ik->i", za, inv, za) + 1 / len(za)
            e = (((yc - za @ w) / (1 - h)) ** 2).sum()
            if best is None or e < best[0]:
                best = (e, w)
        active.pop(int(np.argmin(best[1] ** 2)))
    assert got == want
    rows = MODELS["rfe-ridge-reg"].sweep(long, CELL, {"rfe__n_features_to_select": [2], "ridge__alpha": [1.0]}).collect()
    p = ridge(scaled(x, 120)[:, want[2]], (y - y[:120].mean()) / y[:120].std(), 120, 1.0) * y[:120].std() + y[:120].mean()
    assert rows[0]["r2_test"] == pytest.approx(r2(y[180:], p[180:]), abs=1e-8)


def test_stored_scores_are_reused(spark):
    x, y = data(d=2)
    long = long_rows(spark, x, y, n=100)
    stored = spark.createDataFrame([("r", 100, 0, i, {"alpha": a}, v) for i, (a, v) in enumerate([(0.1, 0.8), (1.0, 0.7)])],
                                   "run string, n int, s int, grid_index int, params map<string,double>, r2_val double")
    got = {r["params"]["alpha"]: r["r2_val"] for r in sweep(long, "ridge-reg", {"alpha": [0.1, 1.0, 10.0]}, ["run"], stored).collect()}
    assert (got[0.1], got[1.0]) == (0.8, 0.7) and got[10.0] not in (None, 0.8, 0.7)
    all_stored = stored.unionByName(spark.createDataFrame([("r", 100, 0, 2, {"alpha": 10.0}, 0.5)], stored.schema))
    assert {r["r2_val"] for r in sweep(long, "ridge-reg", {"alpha": [0.1, 1.0, 10.0]}, ["run"], all_stored).collect()} == {0.8, 0.7, 0.5}


def test_logistic_regression_reaches_the_optimum(spark):
    x, s = data(d=3)
    y = (s > np.median(s)).astype(float)
    row = MODELS["logistic-regression-cls"].sweep(long_rows(spark, x, y), CELL, {}).first()
    z = scaled(x, 120)
    z1 = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1[:120] @ w))
        reg = np.diag([1.0, 1, 1, 0])
        w -= np.linalg.solve((z1[:120].T * (p * (1 - p))) @ z1[:120] + reg, z1[:120].T @ (p - y[:120]) + reg @ w)
    assert row["acc_test"] == pytest.approx((((z1 @ w) > 0) == y)[180:].mean(), abs=1 / 60)


def test_boosting_with_three_classes(spark):
    x, s = data(m=160, d=2)
    y = np.digitize(s, np.quantile(s, [0.33, 0.66])).astype(float)
    row = MODELS["xgb-cls"].sweep(long_rows(spark, x, y), CELL, {"n_estimators": [3], "max_depth": [2]}).first()
    assert row["acc_train"] > 0.5


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="Invalid model type"):
        sweep(spark.range(1), "nope", {}, ["run"])


@pytest.mark.parametrize("x,c,want,mask", [
    ([[1], [2], [3], [4], [5]], [[.1], [.2], [.3], [.4], [.5]], [[0]] * 5, [True] * 5),
    ([[1, 2], [3, 4], [5, 6]], [[.1, .2], [.3, .4], [.5, .6]], [[0, 0]] * 3, [True] * 3),
    ([[1], [2], [NAN], [4], [5]], [[.1], [.2], [.3], [.4], [.5]], [[0], [0], None, [0], [0]], [True, True, False, True, True]),
    ([[1], [2], [3], [4], [5]], [[.1], [.2], [.3], [.4], [NAN]], [[0], [0], [0], [0], None], [True] * 4 + [False]),
])
def test_confound_regression_cases(spark, x, c, want, mask):
    def role(v):
        return with_mask(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "sample_id bigint, data array<double>"))
    rows = {r["sample_id"]: r for r in regress_out(role(x), role(c), check=True).collect()}
    for i, w in enumerate(want):
        assert rows[i]["mask"] == mask[i]
        assert (rows[i]["data"] is None) == (w is None)
        if w is not None:
            assert np.allclose(rows[i]["data"], w, rtol=1e-5, atol=1e-8)


def test_confound_regression_needs_the_same_samples(spark):
    def role(n):
        return with_mask(spark.range(n).selectExpr("id as sample_id", "array(double(id)) as data"))
    with pytest.raises(AssertionError, match="Mismatch"):
        regress_out(role(5), role(4), check=True)


def test_residuals_are_orthogonal_to_covariates(spark):
    rng = np.random.RandomState(0)
    c, x = rng.normal(size=(300, 2)) + 100, rng.normal(size=(300, 3))
    x[:, 0] += c @ [1, 2]

    def role(v):
        return with_mask(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "sample_id bigint, data array<double>"))
    got = np.array([r["data"] for r in regress_out(role(x), role(c)).orderBy("sample_id").collect()])
    assert np.abs(got.T @ (c - c.mean(0))).max() < 1e-6 and np.abs(got.mean(0)).max() < 1e-8


def test_prepare(spark):
    df = spark.createDataFrame([(0, 1.0, 2), (1, NAN, 3), (2, None, 4)], "id long, a double, b int")
    got = [r["mask"] for r in prepare(df, "features", ["a", "b"], "id").orderBy("sample_id").collect()]
    assert got == [True, False, False]
    with pytest.raises(TypeError):
        prepare(spark.createDataFrame([(0, "a")], "id long, a string"), "features", ["a"], "id")
    with pytest.raises(ValueError, match="empty"):
        prepare(df.limit(0), "features", ["a"], "id")
    with pytest.raises(ValueError):
        feature_mode(df, "other", "a", "b")
    with pytest.raises(Exception, match="not finite"):
        require_valid(df, ["a"]).collect()


@pytest.mark.parametrize("n", [300, 2500])
def test_quantile_transform_equals_brute_force(spark, monkeypatch, n):
    import sizeladder.operators.quantile as q
    rng = np.random.RandomState(0)
    v = np.round(rng.exponential(size=n), 2)
    v[rng.rand(n) < 0.33] = 0.5  # one value holds a third of the rows
    few = rng.randint(0, 20, n).astype(float)
    df = spark.createDataFrame([(i, [float(v[i]), float(few[i])]) for i in range(n)], "sample_id bigint, data array<double>")
    k, order = np.arange(min(1000, n)), np.sort(v)
    at, rest = np.divmod(k * (n - 1), k[-1])  # exact positions: percentiles in floating point would split ties
    knots = order[at] + rest / k[-1] * (order[np.minimum(at + 1, n - 1)] - order[at])
    want = interpolate(v, knots)
    got = np.array([r["data"] for r in quantile_transform(df).orderBy("sample_id").collect()])
    assert np.allclose(got[:, 0], want, atol=1e-9) and (got[:, 1] == few).all()
    monkeypatch.setattr(q, "BROADCAST_FEATURES", 0)  # the path for very wide data
    monkeypatch.setattr(q, "CHUNK_ROWS", 500)
    wide = np.array([r["data"] for r in quantile_transform(df).orderBy("sample_id").collect()])
    assert np.allclose(wide, got, atol=1e-12)
    if n == 300:  # with a knot per row this is the scaled mean rank
        lo, hi = np.searchsorted(order, v, "left"), np.searchsorted(order, v, "right") - 1
        mid = (lo + hi) / 2 / (n - 1)
        mid[v == order[0]], mid[v == order[-1]] = 0, 1
        assert np.allclose(want, mid, atol=1e-9)


def test_single_class_and_constant_target(spark):
    x, _ = data(m=40, d=2)
    row = MODELS["mean-reg"].sweep(long_rows(spark, x, np.ones(40)), CELL, {}).first()
    assert row["r2_test"] == 1.0
    row = MODELS["majority-cls"].sweep(long_rows(spark, x, np.ones(40)), CELL, {}).first()
    assert row["acc_test"] == 1.0 and row["params"] == {}


def test_weights_carry_all_points(spark):
    x, y = data(d=2)
    w = fit_linear(long_rows(spark, x, y).where("set = 'train'"), CELL, "ridge", {"alpha": [1.0, 2.0, 3.0]})
    assert sorted(r["params"]["alpha"] for r in w.collect()) == [1.0, 2.0, 3.0]
    assert w.select(F.size("coef")).distinct().first()[0] == 2
