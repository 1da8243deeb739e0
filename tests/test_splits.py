import numpy as np
import pytest
from pyspark.sql import functions as F

from sizeladder.functions.draws import draw_key
from sizeladder.operators.matching import matched_splits
from sizeladder.operators.ranking import kth_draw, rank_by_draw
from sizeladder.operators.splits import Size, make_sizes, make_splits, stratum_quotas

RUN = ["run"]


def samples(spark, y, c=None, valid=None):
    n = len(y)
    c = np.zeros((n, 1)) if c is None else c
    valid = [True] * n if valid is None else valid
    rows = [("r", i, float(y[i]), [float(v) for v in c[i]], bool(valid[i])) for i in range(n)]
    return spark.createDataFrame(rows, "run string, sample_id bigint, y double, c array<double>, valid boolean")


def sets(df, n=None, seed=None):
    out = {}
    for r in df.collect():
        if (n is None or r["n"] == n) and (seed is None or r["seed"] == seed):
            out.setdefault(r["set"], []).append(r["sample_id"])
    return out


def test_sizes_are_exact_and_disjoint(spark):
    y = np.random.RandomState(0).rand(1000)
    splits, status = make_splits(samples(spark, y), [Size(600, 100, 100), Size(50, 10, 10)], [0, 1], RUN)
    for n, total in ((600, (600, 100, 100)), (50, (50, 10, 10))):
        for seed in (0, 1):
            s = sets(splits, n, seed)
            assert tuple(len(s[k]) for k in ("train", "val", "test")) == total
            assert len(set(sum(s.values(), []))) == sum(total)
    assert {r["error"] for r in status.collect()} == {None}
    assert sets(splits, 50, 0) != sets(splits, 50, 1)


def test_result_does_not_depend_on_partitioning(spark):
    y = np.random.RandomState(0).rand(500)
    df = samples(spark, y)
    a = make_splits(df.repartition(1), [Size(50, 10, 10)], [3], RUN)[0]
    b = make_splits(df.repartition(7, "y"), [Size(50, 10, 10)], [3], RUN)[0]
    assert sorted(a.collect()) == sorted(b.collect())


def test_stratified_shares(spark):
    y = (np.arange(1000) % 10 < 3).astype(int)
    splits, _ = make_splits(samples(spark, y), [Size(600, 100, 100)], [0], RUN, stratify=True)
    for ids in sets(splits).values():
        assert abs(np.mean(y[ids]) - 0.3) < 0.011


def test_quotas_add_up(spark):
    strata = spark.createDataFrame([("r", 0, float(k), c) for k, c in enumerate([7, 13, 41, 2])],
                                   "run string, seed int, stratum double, cnt bigint")
    q = stratum_quotas(strata, RUN, [Size(20, 9, 11)]).collect()
    assert [sum(r[k] for r in q) for k in ("q_train", "q_val", "q_test")] == [20, 9, 11]
    assert all(r["q_train"] + r["q_val"] + r["q_test"] <= r["cnt"] for r in q)


def test_mask_and_balance(spark):
    y = (np.arange(900) % 3 == 0).astype(int)
    valid = np.arange(900) % 5 != 0
    splits, status = make_splits(samples(spark, y, valid=valid), [Size(200, 50, 50)], [0], RUN, balanced=True)
    ids = sum(sets(splits).values(), [])
    assert all(valid[i] for i in ids)
    assert status.first()["balanced"]
    many, _ = make_splits(samples(spark, y, valid=valid), [Size(300, 90, 90)], [0], RUN, balanced=True)
    assert abs(np.mean(y[sum(sets(many).values(), [])]) - 0.5) < 0.02  # all 480 balanced rows


@pytest.mark.parametrize("y,sizes,method,message", [
    (np.zeros(500), Size(100, 20, 20), "none", "Only a single class in target"),
    (np.arange(600) % 2, Size(600, 100, 100), "none", "Insufficient samples"),
    (np.arange(600) % 2, Size(100, 1, 1), "none", "Insufficient samples"),
    (np.arange(600) % 3, Size(100, 20, 20), "matching", "Matching requires binary classification"),
    ((np.arange(600) < 20).astype(int), Size(100, 20, 20), "matching",
     "Insufficient samples for matching. Required: 70, Available in minority class: 20"),
])
def test_errors(spark, y, sizes, method, message):
    splits, status = make_splits(samples(spark, y), [sizes], [0], RUN, method)
    assert status.first()["error"] == message
    assert splits.count() == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="Invalid confound correction method"):
        make_splits(samples(spark, np.arange(50) % 2), [Size(10, 4, 4)], [0], RUN, "invalid_method")


@pytest.mark.parametrize("method,stratify,balanced", [("correct-x", True, True), ("none", True, True), ("with-cni", True, False)])
def test_flags(spark, method, stratify, balanced):
    _, status = make_splits(samples(spark, np.arange(400) % 2), [Size(100, 20, 20)], [0], RUN, method, stratify, balanced)
    r = status.first()
    assert (r["stratify"], r["balanced"]) == ((False, False) if method == "correct-x" else (stratify, balanced))


def test_size_rule():
    assert make_sizes([10, 30], 0.25) == [Size(10, 2, 2), Size(30, 8, 8)]  # halves go to the even number
    assert make_sizes([10, 1000], 0.25, 100, 4) == [Size(10, 4, 4), Size(1000, 100, 100)]
    with pytest.raises(ValueError):
        make_sizes([4], 0.25)


def test_ranks_and_cuts_equal_a_plain_window(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").alias("i")) \
        .withColumn("k", draw_key("x", F.col("i")))
    plain = {(r["g"], r["i"]): r["r"] for r in df.selectExpr(
        "g", "i", "row_number() over (partition by g order by k, i) r").collect()}
    got = {(r["g"], r["i"]): r["rank"] for r in rank_by_draw(df, ["g"], "k", "i").collect()}
    assert got == plain
    top = {(r["g"], r["i"]): r["rank"] for r in rank_by_draw(df, ["g"], "k", "i", 37, bits=4).collect()}
    assert top == {k: v for k, v in plain.items() if v <= 37}
    cut = {r["g"]: r["cut_tie"] for r in kth_draw(df, ["g"], "k", "i", F.lit(500)).collect()}
    assert all(plain[g, i] == 500 for g, i in cut.items()) and len(cut) == 2


def greedy(y, c, case_sets, tie):
    """One case after the other takes its nearest free control."""
    w = 1.0 / np.var(c, axis=0)
    used, out = set(), {}
    pool = [i for i in range(len(y)) if y[i] == 0]
    for case in case_sets:
        d = {i: float((((c[case] - c[i]) ** 2) * w).sum()) for i in pool if i not in used}
        best = min(d, key=lambda i: (d[i], tie[i], i))
        used.add(best)
        out[case] = best
    return out


@pytest.mark.parametrize("k,block,duplicates", [(8, None, False), (1, None, False), (1, 7, True)])
def test_matching_equals_serial_greedy(spark, monkeypatch, k, block, duplicates):
    """Short lists and small blocks force many passes; the result stays that of the serial rule."""
    import sizeladder.operators.matching as m
    rng = np.random.RandomState(1)
    n = 160
    y = (np.arange(n) % 4 == 0).astype(int)
    c = rng.normal(size=(n, 2)) + y[:, None]
    if duplicates:  # a third of the controls share one point
        c[1:n:3] = c[1]
        y[1:n:3] = 0
    if block:
        monkeypatch.setattr(m, "LIST_ENTRIES", block)
        monkeypatch.setattr(m, "PROBE_ROWS", 0)
        monkeypatch.setattr(m, "SALT_ROWS", 5)
    monkeypatch.setattr(m, "DIRECT_PAIRS", 0)
    minority = int(y.sum())
    size = Size(2 * (minority // 2), 2 * (minority // 5), 2 * (minority // 5))
    splits, status = matched_splits(samples(spark, y, c), [size], [5], RUN, k=k)
    s = sets(splits)
    ids = sum(s.values(), [])
    assert len(ids) == len(set(ids)) == 2 * (size.n // 2 + size.n_val // 2 + size.n_test // 2)
    frame = spark.range(n).select("id", draw_key("tie", F.col("id")).alias("t"), draw_key("split", F.lit(5), F.col("id")).alias("s"))
    rows = frame.collect()
    tie = {r["id"]: r["t"] for r in rows}
    order = sorted((r["s"], r["id"]) for r in rows if y[r["id"]] == 1)
    ranked = [i for _, i in order]
    ht, hv, h = size.n_test // 2, size.n_val // 2, size.n // 2
    cases = ranked[ht + hv:ht + hv + h] + ranked[ht:ht + hv] + ranked[:ht]
    want = greedy(y, c, cases, tie)
    named = {"train": cases[:h], "val": cases[h:h + hv], "test": cases[h + hv:]}
    for name, part in named.items():
        assert sorted(s[name]) == sorted(part + [want[i] for i in part])
    assert status.first()["average_matching_score"] >= 0
    assert status.first()["samplesize"] == 2 * h


@pytest.mark.parametrize("width, shape, k, probe", [(1, "normal", 3, 10 ** 6), (2, "clusters", 5, 0), (3, "normal", 4, 0), (5, "normal", 2, 10 ** 6),
                                                    (2, "far", 3, 0), (2, "one point", 4, 10 ** 6), (2, "few", 50, 0)])
def test_nearest_controls_equal_all_pairs(spark, monkeypatch, width, shape, k, probe):
    """Cells and radii find what a scan of all pairs finds: with crowded cells, equal points, and cases outside the pool's range."""
    import sizeladder.operators.matching as m
    monkeypatch.setattr(m, "DIRECT_PAIRS", 0)
    monkeypatch.setattr(m, "PROBE_ROWS", probe)
    monkeypatch.setattr(m, "SALT_ROWS", 20)
    rng = np.random.RandomState(width)
    pool = rng.normal(size=(12 if shape == "few" else 400, width))
    cases = rng.normal(size=(40, width))
    if shape == "clusters":
        pool[:300] = pool[0] + rng.normal(size=(300, width)) * 1e-4
        pool[300:350] = pool[0]
    if shape == "far":
        cases[:20] += 100
    if shape == "one point":
        pool[:] = 1.5
    weights = list(rng.uniform(0.5, 2.0, width))
    rows = [(i % 2, 1000 + i, int(rng.randint(10)), [float(v) for v in p]) for i, p in enumerate(pool)]
    asked = [(i % 2, i, [float(v) for v in c]) for i, c in enumerate(cases)]
    want = set()
    for g, i, c in asked:
        far = sorted((sum(w * (a - b) ** 2 for w, a, b in zip(weights, c, p)), tie, j) for h, j, tie, p in rows if h == g)
        want |= {(i, j, place + 1) for place, (_, _, j) in enumerate(far[:k])}
    got = m.nearest_controls(spark.createDataFrame(asked, "grp int, sample_id long, c array<double>"),
                             spark.createDataFrame(rows, "grp int, sample_id long, tie long, c array<double>"), weights, k)
    assert {(r["case_id"], r["control_id"], r["place"]) for r in got.collect()} == want
