"""SQL that fits models itself: trees level by level, Newton steps, and the metrics of predictions."""

from __future__ import annotations

from ..operators.cells import HELD_SHARE
from ..operators.trees import FLAT_ROUNDS, TOLERANCE
from .base import ORDER_LONG

#: Inputs of the tree queries, rounded so that both engines see the same values.
TREE_FEATURES = ("qty", "c_size", "round(c_price, 4)")
CELLS = "n, seed"


def draw_sql(*parts: str) -> str:
    """The 60-bit draw of `draw_key` for the given SQL expressions."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def base_sql(target: str) -> str:
    """`base` (n, seed, sample_id, set, y, stop, boot) and its inputs as `feat` (n, seed, sample_id, f, x)."""
    feats = " UNION ALL ".join(f"SELECT n, seed, sample_id, {i} AS f, CAST({c} AS DOUBLE) AS x FROM long" for i, c in enumerate(TREE_FEATURES))
    return f"""WITH {ORDER_LONG},
base AS MATERIALIZED (SELECT n, seed, sample_id, "set", CAST({target} AS DOUBLE) AS y, {draw_sql("'stop'", "sample_id")} AS stop,
  {draw_sql("'boot'", "sample_id")} AS boot FROM long),
feat AS MATERIALIZED ({feats})"""


def grow_sql(name: str, depth: int, keys: str) -> str:
    """Levels {name}_0 .. {name}_depth of trees over {name}_0 ({keys}, sample_id, w, g, h, node)."""
    out = [f"{name}_u AS (SELECT {keys}, (sum(w * g * g) * sum(w) - sum(w * g) * sum(w * g)) / sum(w * h) AS unit FROM {name}_0 GROUP BY {keys})"]
    for k in range(depth):
        q = f"{name}_{k}"
        out.append(f"""{q}k AS (SELECT {keys}, node, f, x, sum(w * g) AS g, sum(w * h) AS h FROM {q} JOIN feat USING ({CELLS}, sample_id)
  WHERE w > 0 GROUP BY {keys}, node, f, x),
{q}c AS (SELECT *, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER p AS ga, sum(h) OVER p AS ha, lead(x) OVER o AS nx FROM {q}k
  WINDOW o AS (PARTITION BY {keys}, node, f ORDER BY x), p AS (PARTITION BY {keys}, node, f)),
{q}g AS (SELECT {keys}, node, f, x, (x + nx) / 2 AS cut, round((gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha) / unit, 9) AS gain
  FROM {q}c JOIN {name}_u USING ({keys}) WHERE nx IS NOT NULL AND unit > 0),
{q}b AS MATERIALIZED (SELECT {keys}, node, f, cut FROM {q}g WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY {keys}, node ORDER BY gain DESC, f, x) = 1),
{name}_{k + 1} AS MATERIALIZED (SELECT q.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN q.node ELSE 2 * q.node + CASE WHEN x > cut THEN 1 ELSE 0 END END AS node
  FROM {q} q LEFT JOIN {q}b b USING ({keys}, node) LEFT JOIN feat ON q.n = feat.n AND q.seed = feat.seed AND q.sample_id = feat.sample_id AND b.f = feat.f)""")
    return ",\n".join(out)


def leaves_sql(level: str, keys: str) -> str:
    return f"(SELECT {keys}, node, sum(w * g) / sum(w * h) AS v FROM {level} WHERE w > 0 GROUP BY {keys}, node)"


def regression_sql(pred: str = "pred") -> str:
    """Scores of `pred` (n, seed, grid_index, set, y, yhat)."""
    cols = ", ".join(f"round(max({m}) FILTER (\"set\" = '{s}'), {d}) AS {m}_{s}" for m, d in (("r2", 6), ("mae", 2)) for s in ("train", "val", "test"))
    return f"""
per AS (SELECT n, seed, grid_index, "set", 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - yhat)) AS mae
  FROM {pred} GROUP BY n, seed, grid_index, "set")
SELECT n, seed, grid_index, {cols} FROM per GROUP BY n, seed, grid_index"""


def classification_sql(pred: str = "pred") -> str:
    cols = ", ".join(f"round(max({m}) FILTER (\"set\" = '{s}'), 6) AS {m}_{s}" for m in ("acc", "f1") for s in ("train", "val", "test"))
    return f"""
sides AS (SELECT n, seed, grid_index, "set", y AS label, 1 AS own, 0 AS called, CASE WHEN y = yhat THEN 1 ELSE 0 END AS hit FROM {pred}
  UNION ALL SELECT n, seed, grid_index, "set", yhat, 0, 1, 0 FROM {pred}),
labels_ AS (SELECT n, seed, grid_index, "set", label, sum(own) AS own, 2.0 * sum(hit) / (sum(own) + sum(called)) AS f1, sum(hit) AS hit
  FROM sides GROUP BY n, seed, grid_index, "set", label),
per AS (SELECT n, seed, grid_index, "set", CAST(sum(hit) AS DOUBLE) / sum(own) AS acc, CAST(sum(own * f1) / sum(own) AS DOUBLE) AS f1
  FROM labels_ GROUP BY n, seed, grid_index, "set")
SELECT n, seed, grid_index, {cols} FROM per GROUP BY n, seed, grid_index"""


def boosting_sql(target: str, classifier: bool, rates: list[float], depth: int, rounds: int) -> str:
    """All rounds of gradient boosting, the stopping rule, and the scores, one grid point per learning rate."""
    keys = "n, seed, p"
    g, h = ("t - 1 / (1 + exp(-f))", "1 / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f)))") if classifier else ("t - f", "1.0")
    start = "ln(avg(t) / (1 - avg(t)))" if classifier else "avg(t)"
    loss = "2 * avg(greatest(f, 0) + ln(1 + exp(-abs(f))) - t * f)" if classifier else "avg((t - f) * (t - f))"
    t = "y" if classifier else "(y - m) / s"
    out = [base_sql(target), f"""points(p, rate) AS (VALUES {", ".join(f"({i}, {r!r}::DOUBLE)" for i, r in enumerate(rates))})""",
           """st AS (SELECT n, seed, avg(y) AS m, stddev_pop(y) AS s, min(stop) AS first FROM base WHERE "set" = 'train' GROUP BY n, seed)""",
           f"""r AS MATERIALIZED (SELECT base.*, m, s, {t} AS t, "set" = 'train' AND stop <= greatest({2 ** 60 // HELD_SHARE}, first) AS held
  FROM base JOIN st USING (n, seed))""",
           f"""f0 AS (SELECT n, seed, {start} AS f FROM r WHERE "set" = 'train' AND NOT held GROUP BY n, seed)""",
           """s0 AS MATERIALIZED (SELECT n, seed, p, rate, sample_id, "set", t, held, f FROM r JOIN f0 USING (n, seed), points)"""]
    for i in range(rounds):
        out.append(f"""t{i}_0 AS MATERIALIZED (SELECT {keys}, sample_id, CASE WHEN "set" = 'train' AND NOT held THEN 1.0 ELSE 0.0 END AS w, {g} AS g, {h} AS h, 1 AS node FROM s{i})""")
        out.append(grow_sql(f"t{i}", depth, keys))
        out.append(f"""s{i + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (f), f + rate * v AS f FROM s{i} s JOIN t{i}_{depth} USING ({keys}, sample_id)
  JOIN {leaves_sql(f"t{i}_{depth}", keys)} v USING ({keys}, node))""")
    every = " UNION ALL ".join(f"SELECT {i} AS round, * FROM s{i + 1}" for i in range(rounds))
    yhat = "CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END" if classifier else "f * s + m"
    out.append(f"""every AS ({every}),
losses AS (SELECT {keys}, round, {loss} AS loss FROM every WHERE held GROUP BY {keys}, round),
flat AS (SELECT {keys}, round FROM (SELECT *, count(*) OVER w AS before, max(loss) OVER w AS most FROM losses
  WINDOW w AS (PARTITION BY {keys} ORDER BY round ROWS BETWEEN {FLAT_ROUNDS} PRECEDING AND 1 PRECEDING))
  WHERE before = {FLAT_ROUNDS} AND NOT loss + {TOLERANCE!r} < most),
last AS (SELECT {keys}, coalesce(min(flat.round), {rounds - 1}) AS round FROM (SELECT DISTINCT {keys} FROM s0) LEFT JOIN flat USING ({keys}) GROUP BY {keys}),
pred AS (SELECT n, seed, CAST(p AS INTEGER) AS grid_index, every."set", r.y, {yhat} AS yhat FROM every JOIN last USING ({keys}, round)
  JOIN r USING (n, seed, sample_id))""")
    return ",\n".join(out) + "," + (classification_sql() if classifier else regression_sql())


def forest_sql(target: str, classifier: bool, depths: list[int], trees: int) -> str:
    """Bootstraps, trees and scores of random forests that try all features, one grid point per depth."""
    keys = "n, seed, tree"
    levels = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS grid_index, q.n, q.seed, q.tree, q.sample_id, v FROM f_{d} q "
                                f"JOIN {leaves_sql(f'f_{d}', keys)} v USING ({keys}, node)" for i, d in enumerate(depths))
    yhat = "CASE WHEN round(avg(v), 12) > 0.5 THEN 1.0 ELSE 0.0 END" if classifier else "avg(v) * any_value(s) + any_value(m)"
    return base_sql(target) + f""",
st AS (SELECT n, seed, avg(y) AS m, stddev_pop(y) AS s FROM base WHERE "set" = 'train' GROUP BY n, seed),
r AS MATERIALIZED (SELECT base.*, m, s, {"y" if classifier else "(y - m) / s"} AS t FROM base JOIN st USING (n, seed)),
ranked_rows AS (SELECT n, seed, sample_id, row_number() OVER (PARTITION BY n, seed ORDER BY boot, sample_id) - 1 AS place FROM r WHERE "set" = 'train'),
picks AS (SELECT n, tree, (CAST('0x' || substr(md5(concat_ws(':', 'bootstrap', tree, i)), 1, 8) AS BIGINT) * n) >> 32 AS place, count(*) AS w
  FROM (SELECT DISTINCT n FROM r) z, range({trees}) a(tree), LATERAL (SELECT unnest(range(n)) AS i) GROUP BY ALL),
bag AS (SELECT ranked_rows.n, seed, sample_id, tree, w FROM ranked_rows JOIN picks USING (n, place)),
f_0 AS MATERIALIZED (SELECT n, seed, tree, sample_id, coalesce(w, 0) AS w, t AS g, 1.0 AS h, 1 AS node
  FROM (SELECT r.*, tree FROM r, range({trees}) a(tree)) LEFT JOIN bag USING (n, seed, tree, sample_id)),
{grow_sql("f", max(depths), keys)},
grown AS ({levels}),
pred AS (SELECT n, seed, grid_index, any_value(r."set") AS "set", any_value(r.y) AS y, {yhat} AS yhat
  FROM grown JOIN r USING (n, seed, sample_id) GROUP BY n, seed, grid_index, sample_id),""" + (classification_sql() if classifier else regression_sql())


def logistic_sql(target: str, features: tuple[str, str], steps: int) -> str:
    """Newton's method for a penalised logistic regression on two standardised inputs; weights and scores."""
    a, b = features
    out = [f"""WITH {ORDER_LONG},
m AS (SELECT n, seed, avg({a}) AS m1, stddev_pop({a}) AS s1, avg({b}) AS m2, stddev_pop({b}) AS s2 FROM long WHERE "set" = 'train' GROUP BY n, seed),
r AS MATERIALIZED (SELECT n, seed, sample_id, "set", CAST({target} AS DOUBLE) AS y, ({a} - m1) / s1 AS x1, ({b} - m2) / s2 AS x2 FROM long JOIN m USING (n, seed)),
w0 AS (SELECT DISTINCT n, seed, 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM r)"""]
    for i in range(steps):
        out.append(f"""p{i} AS (SELECT r.*, b, u, v, 1 / (1 + exp(-(b + u * x1 + v * x2))) AS p FROM r JOIN w{i} USING (n, seed) WHERE "set" = 'train'),
h{i} AS (SELECT n, seed, any_value(b) AS b, any_value(u) AS u, any_value(v) AS v, sum(p - y) AS g0, sum((p - y) * x1) + any_value(u) AS g1,
  sum((p - y) * x2) + any_value(v) AS g2, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x1) AS d, sum(p * (1 - p) * x2) AS e,
  sum(p * (1 - p) * x1 * x1) + 1 AS f, sum(p * (1 - p) * x1 * x2) AS k, sum(p * (1 - p) * x2 * x2) + 1 AS l FROM p{i} GROUP BY n, seed),
w{i + 1} AS MATERIALIZED (SELECT n, seed, b - (g0 * (f * l - k * k) - d * (g1 * l - k * g2) + e * (g1 * k - f * g2)) / z AS b,
  u - (a * (g1 * l - k * g2) - g0 * (d * l - k * e) + e * (d * g2 - g1 * e)) / z AS u,
  v - (a * (f * g2 - g1 * k) - d * (d * g2 - g1 * e) + g0 * (d * k - f * e)) / z AS v
  FROM (SELECT *, a * (f * l - k * k) - d * (d * l - k * e) + e * (d * k - f * e) AS z FROM h{i}))""")
    head, _, tail = classification_sql().rpartition("\nSELECT n, seed, grid_index")
    return ",\n".join(out) + f""",
pred AS (SELECT n, seed, 0 AS grid_index, "set", y, CASE WHEN b + u * x1 + v * x2 > 0 THEN 1.0 ELSE 0.0 END AS yhat FROM r JOIN w{steps} USING (n, seed)),""" + \
        head + f",\nscored AS (SELECT n, seed, grid_index{tail})\nSELECT scored.* EXCLUDE (grid_index), round(b, 5) AS intercept, round(u, 5) AS w_1, round(v, 5) AS w_2 " \
        f"FROM scored JOIN w{steps} USING (n, seed)"


def optimal_sql(long: str, points: int) -> str:
    """What an optimal fit shows: no violation of its conditions, no imbalance, and the scores that its own values give."""
    return f"""WITH {long}
SELECT n, seed, CAST(i AS INTEGER) AS grid_index, count(*) FILTER ("set" = 'train') AS n_train, 0.0::DOUBLE AS violation, 0.0::DOUBLE AS imbalance,
       TRUE AS agrees FROM long, range({points}) p(i) GROUP BY n, seed, i"""


def pair_sql(target: str, features: tuple[str, str]) -> str:
    """Two standardised inputs z1, z2 with correlation r, a target t and its cross products k1, k2 with the inputs, per cell."""
    a, b = features
    return f"""WITH {ORDER_LONG},
m AS (SELECT n, seed, count(*) AS k, avg({a}) AS m1, stddev_pop({a}) AS s1, avg({b}) AS m2, stddev_pop({b}) AS s2, avg({target}) AS mt, corr({a}, {b}) AS r,
  count(*) * covar_pop({a}, {target}) / stddev_pop({a}) AS k1, count(*) * covar_pop({b}, {target}) / stddev_pop({b}) AS k2
  FROM long WHERE "set" = 'train' GROUP BY n, seed),
z AS MATERIALIZED (SELECT n, seed, sample_id, "set", CAST({target} AS DOUBLE) AS t, ({a} - m1) / s1 AS z1, ({b} - m2) / s2 AS z2, m.* EXCLUDE (n, seed)
  FROM long JOIN m USING (n, seed))"""


def grid_sql(rows: list[tuple]) -> str:
    """points(grid_index, size, alpha)"""
    return "points(grid_index, size, alpha) AS (VALUES " + ", ".join(f"({i}, {s}, {float(a)!r}::DOUBLE)" for i, (s, a) in enumerate(rows)) + ")"


def components_sql(target: str, features: tuple[str, str], rows: list[tuple]) -> str:
    """Ridge on the first principal components: of two standardised inputs these are (1, 1) and (1, -1) over the root of 2."""
    return f"""{pair_sql(target, features)},
{grid_sql(rows)},
c AS (SELECT *, CASE WHEN r > 0 THEN 1 ELSE -1 END AS sign FROM z, points),
pred AS (SELECT n, seed, grid_index, "set", t AS y, mt + (z1 + sign * z2) * (k1 + sign * k2) / 2 / (k * (1 + abs(r)) + alpha)
  + CASE WHEN size > 1 THEN (z1 - sign * z2) * (k1 - sign * k2) / 2 / (k * (1 - abs(r)) + alpha) ELSE 0 END AS yhat FROM c),""" + regression_sql()


def elimination_sql(target: str, features: tuple[str, str], rows: list[tuple], classifier: bool) -> str:
    """The penalty with the least leave-one-out error decides which of two inputs goes; ridge on what is left."""
    yhat = "CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END" if classifier else "v"
    y = "(t + 1) / 2" if classifier else "t"
    return f"""{pair_sql(target, features)},
w AS (SELECT m.*, a, j, ((k + a) * k1 - k * r * k2) / ((k + a) * (k + a) - k * r * k * r) AS w1,
  ((k + a) * k2 - k * r * k1) / ((k + a) * (k + a) - k * r * k * r) AS w2 FROM m, (VALUES (0, 0.1), (1, 1.0), (2, 10.0)) p(j, a)),
loo AS (SELECT n, seed, j, any_value(w1) AS w1, any_value(w2) AS w2, sum(power((t - z.mt - w1 * z1 - w2 * z2) / (1 - 1.0 / z.k - ((z.k + a) * (z1 * z1 + z2 * z2)
  - 2 * z.k * z.r * z1 * z2) / ((z.k + a) * (z.k + a) - z.k * z.r * z.k * z.r)), 2)) AS err FROM z JOIN w USING (n, seed) WHERE "set" = 'train' GROUP BY n, seed, j),
chosen AS (SELECT n, seed, w1 * w1 > w2 * w2 AS first FROM loo QUALIFY row_number() OVER (PARTITION BY n, seed ORDER BY err, j) = 1),
{grid_sql(rows)},
fitted AS (SELECT z.*, grid_index, mt + CASE WHEN size = 1 THEN CASE WHEN first THEN z1 * k1 ELSE z2 * k2 END / (k + alpha)
  ELSE (z1 * ((k + alpha) * k1 - k * r * k2) + z2 * ((k + alpha) * k2 - k * r * k1)) / ((k + alpha) * (k + alpha) - k * r * k * r) END AS v
  FROM z JOIN chosen USING (n, seed), points),
pred AS (SELECT n, seed, grid_index, "set", {y} AS y, {yhat} AS yhat FROM fitted),""" + (classification_sql() if classifier else regression_sql())


def agreeing_sql(long: str, points: int) -> str:
    return f"""WITH {long}
SELECT n, seed, CAST(i AS INTEGER) AS grid_index, count(*) FILTER ("set" = 'train') AS n_train, TRUE AS agrees FROM long, range({points}) p(i) GROUP BY n, seed, i"""
