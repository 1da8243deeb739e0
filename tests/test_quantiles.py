"""Knots found by counting, against sorted columns and against the knots from distinct values."""

import numpy as np
import pytest

from sizeladder.operators import quantile as q


def sorted_knots(v, most):
    v = np.sort(v[np.isfinite(v)])
    k = min(most, len(v)) - 1
    place = np.arange(k + 1) * (len(v) - 1)
    low, share = place // k, (place % k) / k
    return v[low] + np.where(share > 0, share * (v[np.minimum(low + 1, len(v) - 1)] - v[low]), 0.0)


def test_keys_keep_the_order():
    v = np.sort(np.concatenate([np.random.RandomState(0).normal(size=200) * 10.0 ** np.arange(-100, 100), [0.0, 5e-324, -5e-324, 1e308, -1e308]]))
    key = q.ordered_keys(v)
    assert (key[1:] > key[:-1]).all() and (q.from_keys(key) == v).all()
    assert q.ordered_keys(np.array([-0.0])) == q.ordered_keys(np.array([0.0]))


@pytest.mark.parametrize("counters, fetched", [(4_000_000, 128), (64, 128), (200, 3), (16, 0)])
def test_counted_knots(spark, monkeypatch, counters, fetched):
    """Few counters mean many passes, down to single values; frequent values, offsets, wide ranges, gaps and few distinct values."""
    monkeypatch.setattr(q, "COUNTERS", counters)
    monkeypatch.setattr(q, "FETCHED_ROWS", fetched)
    rng = np.random.RandomState(1)
    n = 700
    m = np.stack([rng.normal(size=n), np.where(rng.rand(n) < 0.4, 2.5, rng.normal(size=n)), 1e9 + rng.randint(0, 50, n), rng.randint(0, 5, n),
                  np.exp(rng.normal(size=n) * 40) * rng.choice([-1, 1], n), np.round(rng.normal(size=n), 1) + 0.0], axis=1).astype(float)
    m[rng.rand(n, 6) < 0.05] = np.nan
    m[3, 0], m[4, 1], m[5, 5] = np.inf, -np.inf, -0.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "sample_id long, data array<double>").repartition(5)
    most = 60 if fetched else 25
    got = q.counted_knots(df, most)
    assert sorted(got) == [0, 1, 2, 4, 5]
    for i, knots in got.items():
        assert np.array_equal(knots, sorted_knots(m[:, i], most))
    old = {}
    for r in q.knots(q.value_counts(df), most).collect():
        old.setdefault(r["i"], {})[r["k"]] = r["q"]
    assert {i: [v[k] for k in sorted(v)] for i, v in old.items()} == {i: list(v) for i, v in got.items()}


def test_counting_moves_slices_not_values(spark):
    """The rows that leave a pass are slices: their number follows the knots."""
    rng = np.random.RandomState(2)
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(rng.normal(size=4000))], "sample_id long, data array<double>").repartition(2)
    search = q._Search(4000, float(df.selectExpr("min(data[0])").first()[0]), float(df.selectExpr("max(data[0])").first()[0]), 10)
    assert q._count_slices(df, {0: search}, 64).count() <= 64
    before = len(search.first)
    found = q._count_slices(df, {0: search}, 64).toPandas()
    search.narrow(64, found["bracket"].to_numpy(), found["part"].to_numpy(), found["cnt"].to_numpy())
    assert before == 1 and len(search.first) <= len(search.ranks) <= 20


def test_nothing_to_transform(spark):
    empty = spark.createDataFrame([], "sample_id long, data array<double>")
    assert q.quantile_transform(empty).count() == 0
    few = spark.createDataFrame([(i, [float(i % 3), None]) for i in range(9)], "sample_id long, data array<double>")
    assert q.counted_knots(few) == {}
