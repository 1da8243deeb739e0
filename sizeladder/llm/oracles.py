"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES: dict[str, str] = {}

ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
k AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to FROM k"""

ORACLES["op7_chat_formatting"] = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text, CAST(0 AS BIGINT) AS block FROM conversations),  -- parts of a dialogue: the tables hold none above PART_CHARS
n AS (SELECT *, CAST(0 AS INTEGER) AS split FROM t),
who AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
s AS (
  SELECT n.*, participant, speaker = participant AS own,
         CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = participant THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM n JOIN who ON n.conv_id IS NOT DISTINCT FROM who.conv_id),
p AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (
           PARTITION BY conv_id, participant, block, split ORDER BY turn, speaker, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS first FROM s)
SELECT conv_id, participant, block, split, count(*) AS n_turns, CAST(count(*) FILTER (own) AS BIGINT) AS n_own,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, speaker, text) AS text,
       coalesce(string_agg(CAST(first AS BIGINT) || ':' || CAST(first + length(text) + 7 AS BIGINT), ','
                           ORDER BY turn, speaker, text) FILTER (own), '') AS masks,
       CAST(coalesce(sum(length(text) + 7) FILTER (own), 0) AS BIGINT) AS mask_chars
FROM p GROUP BY conv_id, participant, block, split"""

MIX = f"""
d AS (SELECT *, CAST({WORDS} AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 8) AS BIGINT) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
             3.0::DOUBLE * source_size AS cap FROM sizes),
r AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (1.0::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
               / (sum(w) OVER () - coalesce(sum(w) OVER before, 0.0::DOUBLE)) AS level FROM r
      WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, first(CASE WHEN level <= ratio THEN level END IGNORE NULLS) OVER (
               ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fixed FROM l),
t AS (SELECT source, source_size, CASE WHEN fixed IS NULL THEN cap ELSE fixed * w END AS target FROM x),
targets AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS whole FROM t),
v AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT v.*, sum(words) OVER (PARTITION BY v.source ORDER BY h) AS upto, target - whole * source_size AS budget
      FROM v JOIN targets ON v.source IS NOT DISTINCT FROM targets.source),
edge AS (SELECT source, min(h) + CASE WHEN 2 * arg_min(budget - (upto - words), h) > arg_min(words, h) THEN 1 ELSE 0 END AS threshold
         FROM c WHERE upto > budget AND budget > 0 GROUP BY source),
mixed AS (SELECT d.*, source_size, target, whole + CASE WHEN h < threshold THEN 1 ELSE 0 END AS copies
      FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
      LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source)"""

ORACLES["op9_source_mix"] = f"""
WITH {MIX}
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"""

ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Full Lloyd rounds, each a step of the query; `width` is that of a part."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT v.rid, v.p, b.e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS dist
  FROM v JOIN b{r} b ON v.p = b.p AND v.k = b.k GROUP BY v.rid, v.p, b.e),
a{r} AS MATERIALIZED (SELECT rid, p, e, dist FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY dist, e) = 1),
s{r} AS (SELECT a.p, a.e, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN v ON a.rid = v.rid AND a.p = v.p GROUP BY a.p, a.e, k),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.k, CASE WHEN s IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM b{r} b LEFT JOIN s{r} s ON b.p = s.p AND b.e = s.e AND b.k = s.k)""")
    return f"""
WITH flat AS (SELECT vec_id, label, embedding, unnest(embedding) AS c FROM embeddings WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id, embedding FROM flat WHERE c IS NULL OR NOT isfinite(c)),
kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings t
  WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.vec_id IS NOT DISTINCT FROM t.vec_id
                                              AND bad.embedding IS NOT DISTINCT FROM t.embedding)),
cells AS (SELECT rid, unnest(range(len(embedding))) AS i, unnest(embedding) AS c, len(embedding) // {parts} AS width FROM kept),
v AS MATERIALIZED (SELECT rid, i // width AS p, i % width AS k, CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM cells),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, k, x AS c FROM v WHERE rid <= {entries}),{",".join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)"""


ORACLES["op13_vector_codes"] = codes_sql()
