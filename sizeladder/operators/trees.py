"""Trees for all cells and grid points in one job: gradient boosting and random forests.

The rows of a cell are bounded by the configured sample sizes, so a cell is the unit of work: its rows go to one task, or to
a few that take a share of the grid each, and every task grows the trees of all its grid points together, level by level.
Features are ranked once per cell. For one level and one feature, the gradient sums of all open nodes of all trees are
added up by (node, rank) and scanned once, so the number of array operations depends on levels and features, not on trees.
Only scores leave a task, or predictions or trees where they are asked for. Cells of more than CELL_VALUES numbers are
fitted one by one over the whole cluster instead (:mod:`mllib`).

A split maximises the gain sum(G_left)^2 / H_left + sum(G_right)^2 / H_right - sum(G)^2 / H; its threshold lies midway between
the neighbouring values of the node. Gains are compared after rounding to a billionth of the tree's spread, ties go to the
lower feature and then the lower threshold, and a split must gain something.

Boosting: residuals and second derivatives of the squared, logistic or multinomial loss; Newton steps in the leaves; a tenth
of the training rows, chosen by their draw and never none, tells when to stop: at the first round from the eleventh on whose
loss is not below the largest of the ten rounds before by more than `tolerance`. Forests: every tree draws as many rows as
there are, with replacement, and averages class shares or targets; depths of one grid share their trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .cells import CELL_VALUES, Cell, Features, fit_cells, small_cells, sweep_cells
from .grids import grid_points

BATCH_VALUES = 4_000_000  # trees x rows x outputs that grow together
FLAT_ROUNDS, TOLERANCE = 10, 1e-4


def feature_draws(seeds: np.ndarray, features: int) -> np.ndarray:
    """Independent uniform draws per (seed, feature): a 64-bit mix of both."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(31))


def features_tried(value, features: int) -> int:
    """An integer counts features, a fraction is a share of them; None is all."""
    if value is None:
        return features
    return max(1, min(features, value if isinstance(value, int) else int(value * features)))


def _sums(key: np.ndarray, size: int, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, rising, and the sum of every weight per key."""
    if size <= 4 * len(key):
        found = np.flatnonzero(np.bincount(key, minlength=size))
        return found, [np.bincount(key, w, minlength=size)[found] for w in weights]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts], [np.add.reduceat(w[order], starts) for w in weights]


class Grove:
    """Trees that grow together over the rows of one cell.

    `g` (trees, rows, outputs) and `h` (trees, rows) hold first and second derivatives times the weight of the row; rows
    of weight 0 do not count but are sent down, so that every row ends in a leaf of every tree.
    """

    def __init__(self, features: Features, g: np.ndarray, h: np.ndarray, weight: np.ndarray, depth: np.ndarray,
                 tried: np.ndarray, seeds: np.ndarray):
        self.features, self.tried, self.depth = features, tried, depth
        self.trees, self.rows, self.outputs = g.shape
        self.g, self.h, self.seeds = g.reshape(-1, self.outputs), h.ravel(), seeds
        used = weight.ravel() > 0
        total = lambda a: a.reshape(self.trees, self.rows).sum(axis=1)
        weights = weight.ravel()
        squares = total(np.divide((self.g ** 2).sum(axis=1), weights, out=np.zeros(len(weights)), where=used))
        sums = (g.sum(axis=1) ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.unit = (squares * total(weights) - sums) / total(self.h)
        self.tree = list(range(self.trees))     # of every node; the roots come first
        self.feature = [-1] * self.trees
        self.threshold = [0.0] * self.trees
        self.left, self.right = [-1] * self.trees, [-1] * self.trees
        self.value = np.zeros((self.trees, self.outputs))
        self.at = np.repeat(np.arange(self.trees), self.rows)  # node of every (tree, row)
        self.live, self.used = np.arange(len(self.at)), used
        self.open = np.arange(self.trees)
        self.level = 0

    def settle(self) -> np.ndarray:
        """Values of the open nodes; returns the sums behind them."""
        place = np.full(len(self.tree), -1)
        place[self.open] = np.arange(len(self.open))
        self.place = place
        bag = self.live[self.used[self.live]]
        slot = place[self.at[bag]]
        sums = np.stack([np.bincount(slot, self.g[bag, k], minlength=len(self.open)) for k in range(self.outputs)]
                        + [np.bincount(slot, self.h[bag], minlength=len(self.open))], axis=1)
        top = sums[:, :-1]
        self.value[self.open] = np.divide(top, sums[:, -1:], out=np.zeros_like(top), where=sums[:, -1:] > 1e-150)
        self.bag, self.slot = bag, slot
        return sums

    def scan(self, wanted: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best (gain, feature, threshold) per open node over the features that are `wanted` for it."""
        slots = len(self.open)
        best, where, cut = np.zeros(slots), np.full(slots, -1), np.zeros(slots)
        unit = np.asarray(self.unit)[np.asarray(self.tree)[self.open]]
        rows = self.bag % self.rows
        for f in range(wanted.shape[1]):
            if wanted[:, f].all():
                bag, slot, rank = self.bag, self.slot, self.features.ranks[rows, f]
            else:
                mine = wanted[self.slot, f]
                if not mine.any():
                    continue
                bag, slot = self.bag[mine], self.slot[mine]
                rank = self.features.ranks[rows[mine], f]
            many = len(self.features.values[f])
            key, added = _sums(slot * many + rank, slots * many, [*self.g[bag].T, self.h[bag]])
            owner, rank = key // many, key % many
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            run = np.cumsum(np.stack(added, axis=1), axis=0)
            before = np.zeros((len(first), run.shape[1]))
            before[1:] = run[first[1:] - 1]
            left = run - np.repeat(before, np.diff(np.r_[first, len(key)]), axis=0)
            here = sums[owner]
            right = here - left
            inner = np.r_[owner[1:] == owner[:-1], False] & (left[:, -1] > 0) & (right[:, -1] > 1e-12 * here[:, -1])
            with np.errstate(divide="ignore", invalid="ignore"):
                part = lambda s: (s[:, :-1] ** 2).sum(axis=1) / s[:, -1]
                gain = np.round((part(left) + part(right) - part(here)) / unit[owner], 9)
            gain = np.where(inner & np.isfinite(gain), gain, 0.0)
            most = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[first, len(key)])))[::-1]
            at = np.empty(slots, dtype=np.int64)
            at[owner[hit]] = hit  # the first one is written last
            mine = owner[first]
            better = mine[most > best[mine]]
            at = at[better]
            best[better], where[better] = gain[at], f
            values = self.features.values[f]
            cut[better] = (values[rank[at]] + values[rank[np.minimum(at + 1, len(rank) - 1)]]) / 2
        return best, where, cut

    def step(self, seen=None) -> bool:
        """Split what can be split on this level; False where nothing could. `seen(level)` is called before the split."""
        sums = self.settle()
        if seen:
            seen(self.level)
        tree = np.asarray(self.tree)[self.open]
        may = (self.depth[tree] > self.level) & (np.asarray(self.unit)[tree] > 0)
        d = self.features.x.shape[1]
        tried = self.tried[tree]
        if may.any():
            if (tried < d).any():
                draws = feature_draws(self.seeds[tree] * np.uint64(1 << 20) + (self.open - tree).astype(np.uint64), d)
                wanted = draws.argsort(axis=1).argsort(axis=1) < tried[:, None]
            else:
                wanted = np.ones((len(tree), d), dtype=bool)
            best, where, cut = self.scan(wanted & may[:, None], sums)
            none = may & (where < 0) & (tried < d)
            if none.any():  # no feature drawn can split these nodes: the others are tried
                second = self.scan(~wanted & none[:, None], sums)
                best, where, cut = (np.where(none, b, a) for a, b in zip((best, where, cut), second))
            split = np.flatnonzero(where >= 0)
        else:
            split = np.zeros(0, dtype=int)
        self.level += 1
        if not len(split):
            self.open = self.live = np.zeros(0, dtype=np.int64)
            return False
        born = len(self.tree)
        child = np.full(len(self.open), -1)
        child[split] = born + 2 * np.arange(len(split))
        for s in split:
            node = self.open[s]
            self.feature[node], self.threshold[node] = int(where[s]), float(cut[s])
            self.left[node], self.right[node] = int(child[s]), int(child[s]) + 1
            self.tree += [self.tree[node]] * 2
        for store, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1)):
            store += [empty] * (2 * len(split))
        self.value = np.vstack([self.value, np.zeros((2 * len(split), self.outputs))])
        slot = self.place[self.at[self.live]]
        self.live, slot = self.live[child[slot] >= 0], slot[child[slot] >= 0]
        right = self.features.x[self.live % self.rows, where[slot]] > cut[slot]
        self.at[self.live] = child[slot] + right
        self.open = np.arange(born, len(self.tree))
        return True

    def predictions(self) -> np.ndarray:
        """Values of the nodes the rows are in: (trees, rows, outputs)."""
        return self.value[self.at].reshape(self.trees, self.rows, self.outputs)

    def grow(self) -> "Grove":
        while self.step():
            pass
        return self

    def table(self) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, value) of all nodes, numbered from 0 within their tree."""
        number, count = [], {}
        for t in self.tree:
            number.append(count.get(t, 0))
            count[t] = number[-1] + 1
        link = lambda i: number[i] if i >= 0 else None
        return [(t, number[i], self.feature[i] if self.feature[i] >= 0 else None,
                 self.threshold[i] if self.feature[i] >= 0 else None, link(self.left[i]), link(self.right[i]),
                 self.value[i].tolist()) for i, t in enumerate(self.tree)]


def boost(cell: Cell, points: list[dict], keep=None) -> np.ndarray:
    """Predictions (points, rows) of gradient boosting; all points that have not stopped take a round together.

    `keep` gets a row of NODES for every node of every tree.
    """
    rows, d = cell.x.shape
    k = 1 if not cell.classes or len(cell.classes) <= 2 else len(cell.classes)
    fit, held = cell.fit, cell.held
    if cell.classes:
        share = np.array([(cell.label[fit] == c).mean() for c in range(len(cell.classes))])
        share = np.clip(share, 1e-10, 1 - 1e-10)
        start = np.log(share) if k > 1 else np.array([np.log(share[-1] / (1 - share[-1])) if len(share) > 1 else 0.0])
    else:
        start = np.array([cell.target[fit].mean()])
    f = np.tile(start[:, None], (len(points), 1, rows))
    rates = np.array([float(p.get("learning_rate", 0.1)) for p in points])
    rounds = np.array([int(p.get("n_estimators", 100)) for p in points])
    depth = np.array([int(p.get("max_depth", 3)) for p in points])
    tried = np.array([features_tried(p.get("max_features"), d) for p in points])
    used = [max(1, int(float(p.get("subsample", 1.0)) * fit.sum())) for p in points]
    limits = np.array([float(p.get("tolerance", TOLERANCE)) for p in points])
    losses = np.full((len(points), FLAT_ROUNDS), np.inf)
    if cell.classes and len(cell.classes) < 2:
        return np.full((len(points), rows), cell.classes[0])
    active, r = np.flatnonzero(rounds > 0), 0
    at_once = max(1, BATCH_VALUES // (k * rows))
    while len(active):
        for s in range(0, len(active), at_once):
            some = active[s:s + at_once]
            g, h = _derivatives(cell, f[some])
            weight = np.zeros((len(some), rows))
            for i, p in enumerate(some):
                mine = np.flatnonzero(fit)
                if used[p] < len(mine):  # as many rows as asked for, by a draw of the round
                    draw = feature_draws(np.array([1_000_003 + r]), rows)[0][mine]
                    mine = mine[np.argsort(draw, kind="stable")[:used[p]]]
                weight[i, mine] = 1.0
            weight = np.repeat(weight, k, axis=0)
            g, h = g.reshape(-1, rows) * weight, h.reshape(-1, rows) * weight
            seeds = (np.repeat(np.zeros(len(some)), k) + r * k + np.tile(np.arange(k), len(some))).astype(np.uint64)
            grove = Grove(cell.features, g[:, :, None], h, weight, np.repeat(depth[some], k), np.repeat(tried[some], k), seeds).grow()
            step = grove.predictions()[:, :, 0].reshape(len(some), k, rows)
            if k > 1:
                step = step * ((k - 1) / k)
            f[some] += rates[some, None, None] * step
            if keep:
                for t, nodes in _by_tree(grove):
                    p = some[t // k]
                    scale = rates[p] * ((k - 1) / k if k > 1 else 1.0)
                    for n in nodes:
                        keep(int(p), r, t % k, *n[:-1], [v * scale for v in n[-1]])
        r += 1
        going = rounds[active] > r
        if held.any():
            loss = _loss(cell, f[active], held)
            better = loss + limits[active] < losses[active].max(axis=1)
            losses[active, (r - 1) % FLAT_ROUNDS] = loss
            going &= better
        active = active[going]
    if not cell.classes:
        return f[:, 0] * cell.sd + cell.mean
    names = np.array(cell.classes)
    return names[(f[:, 0] > 0).astype(int)] if k == 1 else names[f.argmax(axis=1)]


def _by_tree(grove: Grove) -> Iterator[tuple[int, list[tuple]]]:
    nodes: dict[int, list] = {}
    for n in grove.table():
        nodes.setdefault(n[0], []).append(n[1:])
    yield from nodes.items()


def _shares(f: np.ndarray) -> np.ndarray:
    if f.shape[1] == 1:
        return 1.0 / (1.0 + np.exp(-f))
    e = np.exp(f - f.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _derivatives(cell: Cell, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and second derivatives of the loss at scores f (points, outputs, rows)."""
    if not cell.classes:
        return cell.target - f, np.ones_like(f)
    p = _shares(f)
    hit = (cell.label == 1)[None] if f.shape[1] == 1 else cell.label == np.arange(f.shape[1])[:, None]
    return hit - p, p * (1 - p)


def _loss(cell: Cell, f: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared error, twice the logistic loss or the multinomial loss, per point."""
    f = f[:, :, rows]
    if not cell.classes:
        return ((cell.target[rows] - f[:, 0]) ** 2).mean(axis=1)
    label = cell.label[rows]
    if f.shape[1] == 1:
        return 2 * (np.logaddexp(0, f[:, 0]) - (label == 1) * f[:, 0]).mean(axis=1)
    top = f.max(axis=1)
    total = np.log(np.exp(f - top[:, None]).sum(axis=1)) + top
    return (total - np.take_along_axis(f, label[None, None], axis=1)[:, 0]).mean(axis=1)


def bootstrap_counts(tree: int, n: int) -> np.ndarray:
    """How often each of n ranked rows is drawn, with replacement, for a tree."""
    picks = [int(hashlib.md5(f"bootstrap:{tree}:{i}".encode()).hexdigest()[:8], 16) * n >> 32 for i in range(n)]
    return np.bincount(picks, minlength=n).astype(float)


def forest(cell: Cell, points: list[dict], keep=None) -> np.ndarray:
    """Predictions (points, rows) of random forests; points that differ in depth or number of trees share trees."""
    rows, d = cell.x.shape
    k = len(cell.classes) if cell.classes else 1
    if cell.classes:
        target = (cell.label[:, None] == np.arange(k)).astype(float)
    else:
        target = cell.target[:, None]
    wanted = [(features_tried(p.get("max_features"), d) if "max_features" in p else (max(1, int(d ** 0.5)) if cell.classes else d),
               int(p.get("max_depth") or 2 ** 31), int(p.get("n_estimators", 100))) for p in points]
    total = np.zeros((len(points), rows, k))
    train = np.flatnonzero(cell.train)
    at_once = max(1, BATCH_VALUES // (k * rows))
    groups: dict[tuple, list] = {}
    for i, (m, depth, trees) in enumerate(wanted):
        groups.setdefault((m, depth if keep else 0), []).append((i, depth, trees))
    for (tried, _), mine in sorted(groups.items()):
        most, deepest = max(t for _, _, t in mine), max(m for _, m, _ in mine)
        for s in range(0, most, at_once):
            trees = np.arange(s, min(most, s + at_once))
            weight = np.zeros((len(trees), rows))
            weight[:, train] = np.stack([bootstrap_counts(int(t), len(train)) for t in trees])
            grove = Grove(cell.features, weight[:, :, None] * target, weight, weight, np.full(len(trees), deepest),
                          np.full(len(trees), tried), trees.astype(np.uint64))
            open_ = {i: (depth, n - s) for i, depth, n in mine if n > s}

            def add(level, grove=grove, open_=open_):
                for i in [i for i, (depth, _) in open_.items() if level is None or depth == level]:
                    n = min(open_.pop(i)[1], grove.trees)
                    total[i] += grove.value[grove.at[:n * rows]].reshape(n, rows, k).sum(axis=0)

            while grove.step(add):
                pass
            add(None)
            for t, nodes in _by_tree(grove) if keep else ():
                for i, _, n in mine:
                    for node in nodes if s + t < n else ():
                        keep(i, s + t, 0, *node)
    mean = total / np.array([w[2] for w in wanted])[:, None, None]
    if cell.classes:
        return np.array(cell.classes)[np.round(mean, 12).argmax(axis=2)]
    return mean[:, :, 0] * cell.sd + cell.mean


# --- all cells -----------------------------------------------------------------------------------------------------

MODELS = {"random-forest-cls": (True, forest), "random-forest-reg": (False, forest), "xgb-cls": (True, boost), "xgb-reg": (False, boost)}
NODES = ("grid_index INT, round INT, output INT, node INT, feature INT, threshold DOUBLE, `left` INT, `right` INT, value ARRAY<DOUBLE>")


def sweep_trees(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str], most: int = CELL_VALUES) -> DataFrame:
    """Scores (cell..., grid_index, params, metrics) of one tree model for every cell and grid point."""
    from .mllib import sweep_mllib
    classifier, fit = MODELS[name]
    points = grid_points(grid)
    cells, small, large = small_cells(long, cell, most)
    out = sweep_cells(small, cell, points, classifier, fit, cells)
    return out if large.isEmpty() else out.unionByName(sweep_mllib(large, name, points, cell))


def tree_predictions(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str]) -> DataFrame:
    """(cell..., grid_index, sample_id, set, y, yhat) of every row."""
    classifier, fit = MODELS[name]
    return fit_cells(long, cell, grid_points(grid), classifier, fit, small_cells(long, cell)[0], "predictions")


def tree_tables(long: DataFrame, name: str, grid: dict | list[dict], cell: list[str]) -> DataFrame:
    """The fitted trees as (cell..., grid_index, round, output, node, feature, threshold, left, right, value), node 0 the root.

    Rows go left where the feature is at most the threshold; features are numbered from 0. Values are class shares of
    forests, and what a tree adds to the (scaled) score in boosting.
    """
    classifier, fit = MODELS[name]
    return fit_cells(long, cell, grid_points(grid), classifier, fit, small_cells(long, cell)[0], NODES)
