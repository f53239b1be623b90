"""DuckDB SQL for the operators that SQL can express."""

MIX = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, source) AS pos
  FROM s GROUP BY source),
weighed AS (SELECT source, n, [3, 1, 2][(pos - 1) % 3 + 1] AS w FROM src),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, source) AS k,
    1.5::DOUBLE * sum(n) OVER ()
      - coalesce(sum(2 * n) OVER (ORDER BY 2.0::DOUBLE * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed),
level AS (SELECT k, room, weights FROM ranked WHERE room * w / weights <= 2.0::DOUBLE * n ORDER BY k LIMIT 1),
goal AS (
  SELECT r.source, r.n AS source_size,
    CASE WHEN r.k < l.k THEN 2.0::DOUBLE * r.n ELSE l.room * r.w / l.weights END AS target
  FROM ranked r, level l),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM goal),
placed AS (
  SELECT s.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(concat_ws(':', 'mix', s.doc_id::VARCHAR)), s.doc_id, s.size
                      ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS before
  FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, n::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON m.id = doc_id
"""

RANKED = r"""
WITH q AS (
  SELECT row_number() OVER () AS q, item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, item_id, t, count(*)::BIGINT AS times FROM q GROUP BY ALL),
d AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT d, doc_id, 25 + (75 * len(w)::BIGINT * n.n) // n.l AS m FROM d, n WHERE len(w) > 0),
p AS (SELECT d, t, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, n GROUP BY t),
s AS (
  SELECT a.q, a.item_id, m.doc_id, p.d, sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM asked a JOIN p USING (t) JOIN w USING (t) JOIN m USING (d) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT d, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::BIGINT AS c FROM t GROUP BY ALL HAVING count(DISTINCT d) >= 3),
lang AS (SELECT lang, count(*)::BIGINT AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::BIGINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0)::BIGINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c, k.c AS lc, l.n AS ln, l.v AS v,
    1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (gn.n + l.v) AS p
  FROM gn JOIN lang l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM lang)),
q AS (SELECT lang, source, term AS item, p, 1 + (1000000000 * (lc + 1)) // (ln + v) AS q FROM p WHERE c > 0),
term AS (SELECT lang, source, item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM q WHERE p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
"""

ORACLES = {"op1_mix_sources": MIX, "op10_near_dedup": NEAR, "op12_ranked_search": RANKED, "op13_source_divergence": DIVERGENCE}
