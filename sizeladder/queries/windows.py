"""Window operators: selection, ranks, splits (W1-W7) and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_key
from ..operators.matching import matched_splits
from ..operators.quantile import quantile_transform
from ..operators.ranking import rank_by_draw
from ..operators.splits import drawn_samples, make_sizes, make_splits, sorted_indices, task_kind, undersample
from ..operators.prepare import to_matrix
from .base import (BEST_ROWS, ORDER_ROWS, ORDER_SEEDS, ORDER_SPLITS, RUN, SEEDS_SQL, VECTOR_SEEDS, VECTOR_SEEDS_SQL,
                   VECTOR_SIZES, VECTOR_SIZES_SQL, best_rows, document_samples, embedding_samples, order_samples,
                   order_splits, query, rounded, stored, table)


@query("w01_best_hyperparameters", "WITH " + BEST_ROWS + """
SELECT model, features, n, s, grid_index, round(r2_val, 8) AS r2_val FROM best_rows""")
def best(spark, sf):
    return best_rows(spark, sf).select("model", "features", "n", "s", "grid_index", rounded(F.col("r2_val"), 8).alias("r2_val"))


KNOT_LIST = "[" + ",".join(f"{k}/999.0" for k in range(1000)) + "]"


@query("w02_quantile_transform", f"""
WITH k AS (SELECT unnest(range(1000)) AS k, unnest(quantile_cont(value, {KNOT_LIST})) AS q FROM events),
g AS (SELECT q, min(k) AS k1, max(k) AS k2, lead(q) OVER (ORDER BY q) AS q_next, lead(min(k)) OVER (ORDER BY q) AS k_next
      FROM k GROUP BY q),
ends AS (SELECT min(q) AS lo, max(q) AS hi FROM k),
v AS (SELECT event_id, value, user_id FROM events)
SELECT event_id AS sample_id, round(CASE WHEN value = lo THEN 0.0 WHEN value = hi THEN 1.0
    WHEN value = q THEN (k1 + k2) / 2.0 / 999 ELSE (k2 + (k_next - k2) * (value - q) / (q_next - q)) / 999 END, 5) AS v,
  CAST(user_id % 7 AS DOUBLE) AS w
FROM v ASOF JOIN g ON v.value >= g.q, ends""")
def quantiles(spark, sf):
    """One continuous feature is transformed, one with seven values is left alone."""
    e = table(spark, sf, "events").select("event_id", "value", (F.col("user_id") % 7).alias("w"))
    out = quantile_transform(to_matrix(e, ["value", "w"], "event_id"))
    return out.select("sample_id", rounded(F.col("data")[0], 5).alias("v"), F.col("data")[1].alias("w"))


@query("w03_seeded_permutation", "WITH " + ORDER_ROWS + ", " + SEEDS_SQL + """
SELECT seed, sample_id, row_number() OVER (PARTITION BY seed ORDER BY
       substr(md5(concat_ws(':', 'split', seed, sample_id)), 1, 16), sample_id) AS rank FROM order_rows, seeds""")
def permutation(spark, sf):
    drawn = drawn_samples(order_samples(spark, sf), [], ORDER_SEEDS)
    keyed = drawn.withColumn("_key", draw_key("split", F.col("seed"), F.col("sample_id")))
    return rank_by_draw(keyed, ["seed"], "_key", "sample_id").select("seed", "sample_id", "rank")


@query("w04_split_assign", "WITH " + ORDER_SPLITS + ' SELECT n, seed, sample_id, "set" FROM splits')
def split_assign(spark, sf):
    return order_splits(spark, sf)[0].select("n", "seed", "sample_id", "set")


def _apportion(name, counts, draws, source):
    """Largest remainder in SQL: exact shares, whole parts, then the largest remainders."""
    return f"""{name}_f AS (SELECT *, ({counts} * ({draws})) // tot AS fl, ({counts} * ({draws})) % tot AS rem FROM (
      SELECT *, sum({counts}) OVER (PARTITION BY seed, n)::BIGINT AS tot FROM {source})),
{name} AS (SELECT * EXCLUDE (fl, rem, tot), fl + CASE WHEN row_number() OVER (PARTITION BY seed, n ORDER BY rem DESC, y)
      <= ({draws}) - sum(fl) OVER (PARTITION BY seed, n) THEN 1 ELSE 0 END AS {name}_q FROM {name}_f)"""


STRATIFIED = ("WITH " + VECTOR_SIZES_SQL + ",\n" + VECTOR_SEEDS_SQL + """,
cc AS (SELECT label AS y, count(*) AS cnt, (SELECT count(*) FROM embeddings) AS total FROM embeddings GROUP BY label),
base AS (SELECT * FROM cc, sizes, seeds),
""" + _apportion("kept", "cnt", "total - n_test", "base") + ",\n" + _apportion("train", "kept_q", "n", "kept") + """,
leftover AS (SELECT *, kept_q - train_q AS rest FROM train),
""" + _apportion("val", "rest", "n_val", "leftover") + """,
ranked AS (SELECT seed, vec_id, label AS y, row_number() OVER (PARTITION BY seed, label ORDER BY
       substr(md5(concat_ws(':', 'split', seed, vec_id)), 1, 16), vec_id) AS rank FROM embeddings, seeds)
SELECT n, seed, vec_id AS sample_id, CASE WHEN rank <= cnt - kept_q THEN 'test' WHEN rank <= cnt - kept_q + val_q THEN 'val'
       ELSE 'train' END AS "set"
FROM ranked JOIN val USING (seed, y) WHERE rank <= cnt - kept_q + val_q + train_q""")


@query("w05_stratified_split", STRATIFIED)
def stratified(spark, sf):
    splits, _ = make_splits(embedding_samples(spark, sf), VECTOR_SIZES, VECTOR_SEEDS, RUN, stratify=True)
    return splits.select("n", "seed", "sample_id", "set")


@query("w06_class_balancing", "WITH " + SEEDS_SQL + """,
e AS (SELECT seed, event_id, event_type, row_number() OVER (PARTITION BY seed, event_type ORDER BY
      substr(md5(concat_ws(':', 'undersample', seed, event_id)), 1, 16), event_id) AS r FROM events, seeds),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM events GROUP BY event_type))
SELECT seed, event_id AS sample_id, event_type FROM e, m WHERE r <= m""")
def balancing(spark, sf):
    """Undersampling every event type to the rarest one, without moving the rows."""
    names = ["click", "error", "purchase", "signup", "view"]
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("event_type")).cast("double")
    e = table(spark, sf, "events").select(F.lit("events").alias("dataset"), F.col("event_id").alias("sample_id"),
                                          code.alias("y"))
    kinds = task_kind(e, RUN, "none", False, True)
    kept = undersample(drawn_samples(e, RUN, ORDER_SEEDS), kinds, RUN)
    return kept.select("seed", "sample_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("y").cast("int"))
                       .alias("event_type"))


MATCH_SIZES = make_sizes([20, 40, 60])
MATCH_SEEDS = [0, 1]

MATCH_CASES = """
docs AS (SELECT doc_id, toxic AS y, CAST(n_chars AS DOUBLE) AS c FROM labels JOIN documents USING (doc_id)),
sizes(n, h, hv, ht) AS (VALUES """ + ", ".join(
    f"({s.n}, {s.n // 2}, {s.n_val // 2}, {s.n_test // 2})" for s in MATCH_SIZES) + """),
seeds(seed) AS (VALUES """ + ", ".join(f"({s})" for s in MATCH_SEEDS) + """),
minority AS (SELECT y, cnt FROM (SELECT y, count(*) AS cnt FROM docs GROUP BY y) ORDER BY cnt, y LIMIT 1),
totals AS (SELECT count(*) AS n_rows FROM docs),
ranked AS (SELECT seed, doc_id, c, row_number() OVER (PARTITION BY seed ORDER BY
      substr(md5(concat_ws(':', 'split', seed, doc_id)), 1, 16), doc_id) AS rank FROM docs JOIN minority USING (y), seeds),
cases AS (SELECT n, seed, doc_id, c, CASE WHEN rank <= ht THEN 'test' WHEN rank <= ht + hv THEN 'val' ELSE 'train' END AS "set",
      CASE WHEN rank <= ht THEN h + hv + rank WHEN rank <= ht + hv THEN h + rank - ht ELSE rank - ht - hv END AS prio
  FROM ranked, sizes, totals, minority WHERE rank <= h + hv + ht AND cnt >= h + hv + ht
   AND n_rows >= n + 2 * round_even(n * 0.25, 0))"""

MATCHED = "WITH RECURSIVE " + MATCH_CASES + """,
spread AS (SELECT var_pop(c) AS v FROM docs),
pool AS (SELECT doc_id, c, substr(md5(concat_ws(':', 'tie', doc_id)), 1, 16) AS tie FROM docs WHERE y NOT IN (SELECT y FROM minority)),
m AS (
  SELECT n, seed, 0::BIGINT AS prio, NULL::BIGINT AS case_id, NULL::VARCHAR AS "set", NULL::BIGINT AS control_id,
         NULL::DOUBLE AS dist, []::BIGINT[] AS used FROM (SELECT DISTINCT n, seed FROM cases)
  UNION ALL
  SELECT n, seed, prio, case_id, "set", best.id, best.d, list_append(used, best.id) FROM (
    SELECT m.n, m.seed, cases.prio, cases.doc_id AS case_id, cases."set", any_value(m.used) AS used,
           min({'d': (cases.c - pool.c) * (cases.c - pool.c) * (1.0 / v), 'tie': pool.tie, 'id': pool.doc_id}) AS best
    FROM m JOIN cases ON cases.n = m.n AND cases.seed = m.seed AND cases.prio = m.prio + 1, pool, spread
    WHERE NOT list_contains(m.used, pool.doc_id)
    GROUP BY m.n, m.seed, cases.prio, cases.doc_id, cases."set")),
pairs AS (SELECT * FROM m WHERE prio > 0)"""


def matched(spark, sf):
    return matched_splits(stored(document_samples(spark, sf, "toxic")), MATCH_SIZES, MATCH_SEEDS, RUN)


@query("w07_minority_half_split", "WITH " + MATCH_CASES + """
SELECT n, seed, doc_id AS sample_id, "set" FROM cases""")
def minority_half(spark, sf):
    """The minority side of the matched splits."""
    splits, _ = matched(spark, sf)
    minority = document_samples(spark, sf, "toxic").where("y = 1").select("sample_id")
    return splits.join(minority, "sample_id", "left_semi").select("n", "seed", "sample_id", "set")


@query("j04_matched_neighbours", MATCHED + """
SELECT n, seed, "set", unnest([case_id, control_id]) AS sample_id FROM pairs""")
def matched_neighbours(spark, sf):
    return matched(spark, sf)[0].select("n", "seed", "set", "sample_id")


@query("a15_matching_distance", MATCHED + """
SELECT n, seed, round(avg(dist), 6) AS average_matching_score FROM pairs GROUP BY n, seed""")
def matching_distance(spark, sf):
    return (matched(spark, sf)[1].where("error is null")
            .select("n", "seed", rounded(F.col("average_matching_score")).alias("average_matching_score")))


TWO_SIZES = make_sizes([64, 256])

# every class is first cut to the size of the smaller one; a case then takes the nearest free control, by both covariates
MATCHED_TWO = "WITH RECURSIVE " + ORDER_ROWS + """,
docs AS MATERIALIZED (SELECT sample_id, CASE WHEN qty > 160 THEN 1 ELSE 0 END AS y, c_size, round(c_price, 4) AS c_price FROM order_rows),
sizes(n, h, hv, ht) AS (VALUES """ + ", ".join(f"({s.n}, {s.n // 2}, {s.n_val // 2}, {s.n_test // 2})" for s in TWO_SIZES) + """),
minority AS (SELECT y, cnt FROM (SELECT y, count(*) AS cnt FROM docs GROUP BY y) ORDER BY cnt, y LIMIT 1),
spread AS (SELECT 1.0 / var_pop(c_size) AS w1, 1.0 / var_pop(c_price) AS w2 FROM docs),
ranked AS (SELECT sample_id, c_size, c_price, row_number() OVER (ORDER BY substr(md5(concat_ws(':', 'split', 0, sample_id)), 1, 16), sample_id) AS rank
  FROM docs JOIN minority USING (y)),
cases AS MATERIALIZED (SELECT n, sample_id, c_size, c_price, CASE WHEN rank <= ht THEN 'test' WHEN rank <= ht + hv THEN 'val' ELSE 'train' END AS "set",
      CASE WHEN rank <= ht THEN h + hv + rank WHEN rank <= ht + hv THEN h + rank - ht ELSE rank - ht - hv END AS prio
  FROM ranked, sizes, minority WHERE rank <= h + hv + ht AND cnt >= h + hv + ht),
pool AS MATERIALIZED (SELECT sample_id, c_size, c_price, tie FROM (
  SELECT *, substr(md5(concat_ws(':', 'tie', sample_id)), 1, 16) AS tie,
         row_number() OVER (ORDER BY substr(md5(concat_ws(':', 'undersample', 0, sample_id)), 1, 16), sample_id) AS r
  FROM docs WHERE y NOT IN (SELECT y FROM minority)), minority WHERE r <= cnt),
m AS (
  SELECT n, 0::BIGINT AS prio, NULL::BIGINT AS case_id, NULL::VARCHAR AS "set", NULL::BIGINT AS control_id, []::BIGINT[] AS used FROM (SELECT DISTINCT n FROM cases)
  UNION ALL
  SELECT n, prio, case_id, "set", best.id, list_append(used, best.id) FROM (
    SELECT m.n, cases.prio, cases.sample_id AS case_id, cases."set", any_value(m.used) AS used,
           min({'d': (cases.c_size - pool.c_size) * (cases.c_size - pool.c_size) * w1 + (cases.c_price - pool.c_price) * (cases.c_price - pool.c_price) * w2,
                'tie': pool.tie, 'id': pool.sample_id}) AS best
    FROM m JOIN cases ON cases.n = m.n AND cases.prio = m.prio + 1, pool, spread
    WHERE NOT list_contains(m.used, pool.sample_id)
    GROUP BY m.n, cases.prio, cases.sample_id, cases."set"))
SELECT n, 0 AS seed, "set", unnest([case_id, control_id]) AS sample_id FROM m WHERE prio > 0"""


@query("j04_matched_two_covariates", MATCHED_TWO)
def matched_two(spark, sf):
    """Orders with many or few lines, matched on two covariates; balanced first."""
    samples = order_samples(spark, sf, ("qty",)).withColumn("y", (F.col("x")[0] > 160).cast("double"))
    samples = samples.withColumn("c", F.array(F.col("c")[0], F.round(F.col("c")[1], 4)))
    splits, _ = matched_splits(stored(samples), TWO_SIZES, [0], RUN, balanced=True)
    return splits.select("n", "seed", "set", "sample_id")


@query("t01_sorted_indices", "WITH " + ORDER_SPLITS + """
SELECT n, seed, string_agg(sample_id, ',' ORDER BY sample_id) FILTER ("set" = 'train') AS train,
       string_agg(sample_id, ',' ORDER BY sample_id) FILTER ("set" = 'val') AS val,
       string_agg(sample_id, ',' ORDER BY sample_id) FILTER ("set" = 'test') AS test FROM splits GROUP BY n, seed""")
def indices(spark, sf):
    out = sorted_indices(order_splits(spark, sf)[0], RUN)
    return out.select("n", "seed", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("train", "val", "test")])
