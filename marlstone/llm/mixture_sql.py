"""DuckDB SQL of the queries for divergence, clustering and mixing."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM vocabulary GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN vocabulary USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY 1, 2),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, x.term, coalesce(c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v) AS q
  FROM groups g JOIN vocabulary x USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def clusters(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Plain rounds in which every vector is compared with every centroid."""

    def assigned(r: int) -> str:
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"""a{r} AS MATERIALIZED (SELECT n, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.n, c.c, CAST({d} AS BIGINT) AS d FROM v, c{r} c) GROUP BY n)"""

    def moved(r: int) -> str:
        return f"""s{r} AS MATERIALIZED (SELECT c, i, floor_div(sum(e)::BIGINT, count(*)) AS m FROM (SELECT a.best.c AS c, unnest(v.x) AS e, unnest(range({dims})) AS i FROM v JOIN a{r} a USING (n)) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(y.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM s{r} GROUP BY c) y USING (c))"""

    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    steps = steps.replace("floor_div(sum(e)::BIGINT, count(*))", "(sum(e)::BIGINT - ((sum(e)::BIGINT % count(*)) + count(*)) % count(*)) // count(*)")
    return f"""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(e, lambda y: CAST(floor({scale} * y) AS BIGINT)) AS x FROM u),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k}),
{steps},
{assigned(rounds)},
o AS (SELECT v.vec_id, a.best.c AS cluster, a.best.d AS distance FROM v JOIN a{rounds} a USING (n))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM o JOIN c{rounds} c ON c.c = o.cluster
"""


MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS k FROM w),
l AS (SELECT k, 2 * n / w AS own, ((SELECT 1.5::DOUBLE * sum(n) FROM s) - coalesce(sum(2 * n) OVER before, 0)) AS rest, sum(w) OVER after AS ws FROM r
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT rest, ws FROM l WHERE own >= rest / ws ORDER BY k LIMIT 1),
t AS (SELECT source, n, CAST(least(2 * n, rest * w / ws) AS DOUBLE) AS target FROM r, level),
b AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS times FROM t),
c AS (SELECT d.*, n, target, times, target - times * n AS more, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, upto <= more OR (upto - size < more AND upto - more <= more - (upto - size)) AS again FROM c)
SELECT doc_id, source, size, n AS source_size, target, size * (times + CASE WHEN again AND more > 0 THEN 1 ELSE 0 END) AS taken FROM e
"""
