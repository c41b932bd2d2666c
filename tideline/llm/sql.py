"""DuckDB SQL for the queries that SQL can express."""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS lim,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM src),
lev AS (
  SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY lim / w, source ASC NULLS LAST) AS place
  FROM named),
shared AS (SELECT arg_min(level, place) AS level, min(lim / w) AS free FROM lev WHERE level <= lim / w),
goal AS (
  SELECT source, source_size,
         CASE WHEN lim / w < s.free THEN lim ELSE least(lim, s.level * w) END AS target
  FROM lev, shared s),
placed AS (
  SELECT z.*, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized z JOIN goal g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
             + least(size, greatest(0, budget - budget // source_size * source_size - before)) END)::BIGINT AS taken
FROM placed
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN []
         WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM w),
sh AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.r AS ra, b.r AS rb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM sh a JOIN sh b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT ra, rb FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
reach AS (
  SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.rb FROM reach JOIN links ON reach.b = links.ra)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets JOIN reach ON sets.r = reach.a JOIN sets o ON o.r = reach.b GROUP BY sets.r, sets.doc_id, len(sets.s)
"""

OP5 = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _op11(k: int = 40, rounds: int = 5) -> str:
    near = """a{n} AS (
  SELECT r, arg_min(number, (d, number)) AS cluster, min(d) AS distance FROM (
    SELECT v.r, c.number, (list_dot_product(v.q, v.q) - 2 * list_dot_product(v.q, c.q) + list_dot_product(c.q, c.q))::BIGINT AS d FROM v, c{n} c)
  GROUP BY r)"""
    move = """s{n} AS (
  SELECT a.cluster, t.i, sum(v.q[t.i]::HUGEINT) AS s, count(*)::HUGEINT AS n FROM v JOIN a{n} a USING (r), range(1, 65) t(i) GROUP BY 1, 2),
m{n} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS q FROM s{n} GROUP BY 1),
c{m} AS (SELECT c.number, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.number)"""
    parts = [near.format(n=0)]
    for n in range(rounds):
        parts += [move.format(n=n, m=n + 1), near.format(n=n + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), q) - 1 AS number, q FROM v WHERE vec_id IS NOT NULL
  QUALIFY number < {k}),
{", ".join(parts)},
total AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia, (sum(sum(distance)) OVER ())::BIGINT AS inertia FROM a{rounds} GROUP BY 1)
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.distance, t.cluster_inertia, t.inertia,
       sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN total t ON t.cluster = a.cluster JOIN c{rounds} c ON c.number = a.cluster
"""


OP12 = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(f) WHERE NOT contains(o, f)),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
m AS (
  SELECT w.part, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN said s ON s.doc_id = w.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
steps AS (SELECT o, i, substr(o, i, 1) AS own, substr(o, 1, i - 1) AS before FROM orders, range(1, 6) t(i) WHERE length(o) = 5),
met AS (
  SELECT c.*, s.*, contains(fails, own) AS hit, fails <> '' AND before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone
  FROM cells c, steps s)
SELECT part, o AS filter_order, i::INTEGER AS step,
       coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost,
       (any_value(x.shapley))::BIGINT AS shapley
FROM met JOIN (SELECT part AS p, own AS f, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS shapley FROM met GROUP BY 1, 2) x ON x.p = part AND x.f = own
GROUP BY 1, 2, 3
"""

ORACLES = {"op11_gemm_kmeans": _op11(), "op12_mask_audit": OP12, "op5_bitsliced_topk": OP5, "op8_parity_join": OP8, "op9_source_mixing": OP9}
